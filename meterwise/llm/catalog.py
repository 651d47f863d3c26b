"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, jaccard_join, langid, merkle, mixing, rule_ensemble, secret_links, token_store, topk, toxicity, url_rules, warc,
               whitening)
from ._tables import crc_mod, table, text_key

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
TOXIC_AT, GOOD_AT = 0.7, 0.3
# The URL rules (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector among all others, by the bit-sliced index."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5, F.pmod("id", F.lit(50)) == 0)


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets per document; the method adds linked weak parts."""
    docs = table(spark, sf_dir, "documents")
    spans = secret_links.scan(docs)
    place = F.array_position(F.array(*[F.lit(k) for k in secret_links.KINDS]), F.col("kind"))
    one = F.struct("start", place.alias("place"), "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))
    per = spans.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in secret_links.BASE], F.sort_array(F.collect_list(one)).alias("all"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(per, _same("doc_id", "i") & (F.col("key") == F.col("k")), "left")
    found = F.coalesce("all", F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,span:string>>"))

    def listed(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: s["span"]), ",")

    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in secret_links.BASE],
                       F.sha2(listed(F.filter(found, lambda s: s["place"] <= len(secret_links.BASE))), 256).alias("base_sha256"), listed(found).alias("spans"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule, else the list of URLs that several pages share, else allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shared = pages.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("url", F.lit("block").alias("verdict"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(pages, "url", rules, shared).select("page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from the rows whose id digest is not 0 modulo 5."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, "doc_id", "text", "lang", ~held & F.col("doc_id").isNotNull())
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), "text", model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learnt from the labels whose id digest is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_held_out(docs, table(spark, sf_dir, "labels"))
    held = crc_mod(F.col("doc_id"), 3) == 1
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), "text", model).select(
        "doc_id", "held_out", "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "evidence")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back through the index."""
    index = warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html", min_revisit=0)
    return warc.read(index, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(TOKENIZER), END_ID))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.taken_words(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingle sets of Jaccard similarity 0.8 or more."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark window, and the items they come from."""
    rows = decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that it folds to after half of the texts lost their line ends."""
    docs = table(spark, sf_dir, "documents")
    joined = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.build(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": joined})
    return merkle.prove(manifest).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on the 32 first components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by weighed rules; learnt from the labels whose id digest is not 0 modulo 5."""
    rows = rule_ensemble.described(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    model = rule_ensemble.fit(rows, table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) != 0))
    scored = rule_ensemble.score(rows, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"), "rules")


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_secret_links, op3_url_rules, op4_language_id, op5_toxicity, op6_warc, op7_token_store,
                                   op8_mixing, op9_jaccard_join, op10_decontamination, op11_merkle_manifest, op12_whitening, op13_quality_rules)} | {"pipeline": corpus_pipeline.run}

def _part(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _levels(name: str, first: str, group: str) -> str:
    """A tree's nodes (l, pos, h) of ``n`` on the level, and each one's siblings (lo, hi)."""
    return f"""{name} AS ({first} UNION ALL
  SELECT {group}, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {group}, l, pos // 3, n),
{name}_s AS (SELECT a.{group}, a.l, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM {name} a JOIN {name} b ON a.{group} IS NOT DISTINCT FROM b.{group} AND a.l = b.l AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.{group}, a.l, a.pos)"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op1_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op3_url_rules": f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), {_AZ}) AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, url, host, path, (SELECT max_by({{'rule': rhost || rpath, 'v': v}}, length(rhost || rpath)) FROM r
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit FROM h),
n AS (SELECT url, count(*) AS n FROM pages GROUP BY url)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.v, CASE WHEN n > 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN n USING (url)""",
    # the lowest bit of crc32: a byte, then eight shifts (marked -1)
    "op11_merkle_manifest": f"""
WITH RECURSIVE c AS (SELECT *, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
    lambda x: CASE WHEN x = '' THEN [] ELSE [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] END)),
    lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) ELSE xor(a, b) END) & 1 = 1 AS even FROM documents),
lf AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN even THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER () AS r FROM lf),
{_levels('t', 'SELECT source, 0 AS l, pos, leaf AS h, n FROM p', 'source')},
g AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels('u', "SELECT 0 AS one, 0 AS l, pos, subroot AS h, n FROM g", 'one')},
q AS (SELECT r, l, lo, hi FROM p JOIN t_s s ON s.source IS NOT DISTINCT FROM p.source AND s.pos = p.pos // CAST(pow(3, l) AS BIGINT)
  UNION ALL SELECT r, 1000 + l, lo, hi FROM p JOIN g ON g.source IS NOT DISTINCT FROM p.source JOIN u_s s ON s.pos = g.pos // CAST(pow(3, l) AS BIGINT)),
f AS (SELECT r, string_agg(lo || hi, '' ORDER BY l) AS proof, list(lo || '.' || hi ORDER BY l) AS path FROM q GROUP BY r),
o AS (SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([coalesce(changed, leaf)] || coalesce(path, []), lambda a, b: sha256(split_part(b, '.', 1) || a || split_part(b, '.', 2))) AS folded_root
  FROM p JOIN g ON g.source IS NOT DISTINCT FROM p.source LEFT JOIN f USING (r))
SELECT *, folded_root = root AS verified FROM o""",
    "op9_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON c.doc_id = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM c WHERE c.doc_id = s.doc_id) AS component_id FROM s""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'p': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS x
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, x.p AS p, dw.n AS n, item_id FROM dw JOIN bw ON x.g = bw.g AND dw.n = bw.n),
k AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
