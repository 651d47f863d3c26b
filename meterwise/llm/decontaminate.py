"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

The windows (``width`` consecutive words of an item; a shorter item is one
window) are numbered by content, so items that share a passage share its
windows.  One pass over the texts counts the benchmark's terms and ranks those of
each window; the index stores the postings (term, document, position) of the
terms that are among the rarest ``ranks`` of some window, and no others.  The
postings of a window's rarest term give its alignments with documents; the lists
of the next rarest terms, shifted by their offsets, are intersected with them;
what is left is compared with the document's words, so only exact phrases are
reported.  With ``slop`` over 0 the search also returns proximity matches:
windows whose rarest terms all occur within ``slop`` words of their places.

The index folds case by Unicode rules (a superset); the final comparison folds
A-Z only, as the definition asks.  Documents are named by id and a digest of
the text.  A text with candidates is split once and compared in stretches of
``STRETCH`` positions, so no task gathers a long text's candidates.

Defined cases: null texts have no words; items without words have no
window; the windows of an item with a null id are hits, but it is in no list of
items; repeated rows are marked alike; empty tables give no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, text_key

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
WIDTH, RANKS, STRETCH = 13, 3, 8192
BROADCAST = 1_000_000  # terms (8 bytes each) up to which every task gets them; beyond, terms are met in a shuffle
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; the first and last entry may be empty."""
    return F.split(F.translate(text, *_AZ), NON_WORD, -1)


def benchmark_items(df: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words: whole items with at least one word."""
    rows = df.select(F.col(id_col).alias("item_id"), F.filter(words(F.col(text_col)), lambda x: x != "").alias("words"))
    return rows.filter(F.size("words") > 0).distinct()


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """win (digest of the words), len, phrase, item_id: every window of every item."""
    n = F.size("words")
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array(F.lit(0)))
    rows = items.select("item_id", "words", F.explode(starts).alias("start"), F.least(n, F.lit(width)).alias("len"))
    rows = rows.select("item_id", "len", F.slice("words", F.col("start") + 1, F.col("len")).alias("phrase"))
    return rows.withColumn("win", F.unhex(F.sha2(F.array_join("phrase", " "), 256))).distinct()


def _tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, -1)


def frequencies(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """df: how often each of the ``terms`` (tid) occurs in all texts; no term's rows meet in one task uncounted."""
    tokens = docs.select(F.explode(_tokens(F.col(text_col))).alias("term")).select(F.xxhash64("term").alias("tid"))
    if terms.count() <= BROADCAST:
        return tokens.join(F.broadcast(terms), "tid").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    return tokens.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).join(terms, "tid", "left_semi")


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """Postings (tid, id, key, pos, n) of the ``terms`` (tid); position 0 of every text is there, with a null tid where it is none of them.

    ``n`` is the number of entries of the split text without the empty ones at its ends: its words.
    """
    entries = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), _tokens(F.col(text_col)).alias("t"))
    empty = F.when(F.element_at("t", 1) == "", 1).otherwise(0) + F.when((F.size("t") > 1) & (F.element_at("t", -1) == ""), 1).otherwise(0)
    tokens = entries.select("id", "key", (F.size("t") - empty).cast("long").alias("n"), F.posexplode("t").alias("pos", "term"))
    tokens = tokens.select("id", "key", "n", "pos", F.xxhash64("term").alias("at"))
    terms = F.broadcast(terms) if terms.count() <= BROADCAST else terms
    return tokens.join(terms, F.col("at") == F.col("tid"), "left").filter("tid is not null or pos = 0").select("tid", "id", "key", "pos", "n")


def _aligned(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, ranks: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """The index, and the places (id, key, win, len, pos, exact) where all the rarest terms of a window meet."""
    slots = windows.select("win", "len", "phrase").distinct().select("win", "len", F.posexplode("phrase").alias("q", "word"))
    slots = cut(slots.select("win", "len", "q", F.xxhash64(F.lower("word")).alias("tid")), "bench-slots")
    frequency = cut(frequencies(docs, text_col, cut(slots.select("tid").distinct(), "bench-terms")), "frequencies")
    order = Window.partitionBy("win").orderBy(F.col("df").asc_nulls_first(), "q")
    ranked = cut(slots.join(frequency, "tid", "left").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
                 .groupBy("win", "len").agg(
                     F.sort_array(F.collect_list(F.struct("rank", "q", "tid", "df"))).alias("rare"))  # at most ``ranks`` entries
                 .filter(F.forall("rare", lambda r: r["df"].isNotNull())), "bench-windows")
    terms = cut(ranked.select(F.explode("rare.tid").alias("tid")).distinct(), "rare-terms")
    index = cut(build_index(docs, id_col, text_col, terms), "postings")

    def rare(r: int, field: str) -> Column:
        return F.get("rare", F.lit(r))[field]

    names = ["id", "key", "win", "len", "rare", "delta", "exact"]
    found = index.join(ranked.withColumn("tid", rare(0, "tid")), "tid").withColumn("delta", F.col("pos") - rare(0, "q"))
    found = found.withColumn("exact", F.lit(True)).select(*names).distinct()
    for r in range(1, ranks):
        found = cut(found, f"aligned-{r}")
        need = found.withColumn("tid", rare(r, "tid")).withColumn("at", F.col("delta") + rare(r, "q"))
        done, need = need.filter("tid is null").select(*names), need.filter("tid is not null")
        lists = index.join(ranked.select(rare(r, "tid").alias("tid")).filter("tid is not null").distinct(), "tid", "left_semi")
        lists = lists.select(F.col("tid").alias("t"), F.col("id").alias("i"), F.col("key").alias("k"), F.col("pos").alias("p"))
        same = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("tid") == F.col("t"))
        if slop:
            step = slop + 1
            need = need.withColumn("cell", F.explode(F.array(*[F.floor(F.col("at") / step) + d for d in (-1, 0, 1)])))
            met = need.join(lists.withColumn("c", F.floor(F.col("p") / step)), same & (F.col("cell") == F.col("c")))
            met = met.filter(F.abs(F.col("p") - F.col("at")) <= slop).withColumn("exact", F.col("exact") & (F.col("p") == F.col("at")))
            met = met.groupBy("id", "key", "win", "len", "rare", "delta").agg(F.max("exact").alias("exact"))
        else:
            met = need.join(lists, same & (F.col("at") == F.col("p"))).select(*names).distinct()
        found = met.select(*names).unionByName(done)
    return index, cut(found.select("id", "key", "win", "len", F.col("delta").alias("pos"), "exact"), "aligned")


def _phrases(docs: DataFrame, found: DataFrame, windows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The places of ``found`` (id, key, win, len, pos) that hold their window word for word."""
    found = found.filter("exact and pos >= 0").select("id", "key", "win", "len", "pos")
    named = cut(found.select(F.col("id").alias("i"), F.col("key").alias("k")).distinct(), "candidates")
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = texts.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi")
    texts = texts.groupBy("id", "key").agg(F.first("text").alias("text"))
    # split once, written, and only then dealt in stretches that overlap by a window
    texts = cut(texts.select(F.col("id").alias("i"), F.col("key").alias("k"), words(F.col("text")).alias("words")), "candidate-texts")
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / STRETCH).cast("int")),
                            lambda x: F.struct(x.alias("s"), F.slice("words", x * STRETCH + 1, F.lit(STRETCH + width)).alias("part")))
    parts = texts.select("i", "k", F.explode(stretches).alias("e")).select("i", "k", "e.s", "e.part")
    places = found.withColumn("stretch", F.floor(F.col("pos") / STRETCH).cast("int"))
    both = places.join(parts, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("stretch") == F.col("s")))
    both = both.select("id", "key", "win", "len", "pos", F.slice("part", F.col("pos") % STRETCH + 1, F.col("len")).alias("there"))
    expected = windows.select(F.col("win").alias("w"), "phrase").distinct()
    return both.join(expected, (F.col("win") == F.col("w")) & (F.col("there") == F.col("phrase"))).select("id", "key", "win", "len", "pos")


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
           ranks: int = RANKS, slop: int = 0) -> DataFrame:
    """id, key, item_id, pos (of the window in the document's words), len, kind (phrase or proximity)."""
    windows = cut(item_windows(benchmark_items(benchmark), width), "bench-phrases")
    _, found = _aligned(docs, windows, id_col, text_col, ranks, slop)
    out = cut(_phrases(docs, found, windows, id_col, text_col, width), "phrases").withColumn("kind", F.lit("phrase"))
    if slop:
        names = ["id", "key", "win", "pos"]
        phrases = out.select(*[F.col(c).alias(f"p_{c}") for c in names])
        near = found.join(phrases, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in names], "left_anti")
        out = out.unionByName(near.select("id", "key", "win", "len", "pos").withColumn("kind", F.lit("proximity")))
    items = windows.select("win", "item_id")
    return out.join(items, "win").select("id", "key", "item_id", "pos", "len", "kind").distinct()


def marked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, key, n_words, n_hit, items (sorted ids as text) per document row."""
    windows = cut(item_windows(benchmark_items(benchmark), width), "bench-phrases")
    index, found = _aligned(docs, windows, id_col, text_col, RANKS, 0)
    found = cut(_phrases(docs, found, windows, id_col, text_col, width), "phrases")
    hits = (found.select("id", "key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("p")).distinct()
            .groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit")))
    names = windows.select("win", F.col("item_id").cast("string").alias("item")).distinct()
    items = (found.select("id", "key", "win").distinct().join(names, "win").select("id", "key", "item").distinct()
             .groupBy("id", "key").agg(F.sort_array(F.collect_set("item")).alias("items")))
    both = hits.join(items.select(F.col("id").alias("i"), F.col("key").alias("k"), "items"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    both = cut(both.select(F.col("id").alias("hid"), F.col("key").alias("hkey"), "n_hit", "items"), "marks")
    rows = index.filter("pos = 0").select("id", "key", F.col("n").alias("n_words"))
    rows = rows.join(both, F.col("id").eqNullSafe(F.col("hid")) & (F.col("key") == F.col("hkey")), "left")
    return rows.select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """The contamination rule on n_hit and n_words: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
