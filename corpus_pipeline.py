"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, token files.

Every stage takes all documents that the stage before it kept, as Parquet, and
returns a DataFrame; its decisions take effect: rejected documents are gone,
one document of each near-duplicate group stays (the smallest id), contaminated
documents are gone, and the mix repeats a document once for every epoch that
plays it; of the one document of a source with which its target is reached, the
words up to there are a row of their own (documents that it does not play are
gone).  The last stage returns the token files' directory, read back from the
files.

Rows are named by their id and a digest of the text, so null or repeated ids
are kept apart (the same id, text and source several times are one document
with all their plays); documents without words are linked with nothing and stay
until the mix, which plays words.  Very long texts go through every stage whole;
of equal choices the smallest id, then the smallest digest stays.  Empty tables
give empty results, missing labels or benchmark items reject nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterwise.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from meterwise.llm._tables import cut, shared_folder, table, text_key

TOXIC_AT = 0.7
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", text_key(F.col("text")))


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_r_id")) & (F.col("_key") == F.col("_r_key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_held_out(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, "text", model, "_tox_", keep_text=True)
    return scored.filter(F.col("_tox_score") < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = jaccard_join.join(docs)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("p")
    kept = rows.filter("component is not null").groupBy("component").agg(first).select("p.id", "p.key")
    alone = rows.filter("component is null").select("id", "key").distinct()
    kept = kept.withColumn("_alone", F.lit(False)).unionByName(alone.withColumn("_alone", F.lit(True)))
    kept = cut(kept.select(F.col("id").alias("_r_id"), F.col("key").alias("_r_key"), "_alone"), "kept")
    # of repeated rows one stays; those without words are all alone
    turn = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("_key"))
    stay = _named(docs).join(kept, _same()).withColumn("_turn", F.when(F.col("_alone"), 1).otherwise(turn))
    return stay.filter("_turn = 1").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marks = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"))
    bad = cut(marks.filter(decontaminate.contaminated()).select(F.col("id").alias("_r_id"), F.col("key").alias("_r_key")).distinct(), "contaminated")
    return _named(docs).join(bad, _same(), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = [F.col("id").alias("_r_id"), F.col("key").alias("_r_key"), F.col("source").alias("_source")]
    plays = mixing.taken_words(docs).groupBy(*named).agg(F.sum("plays").alias("_plays"), F.max("part").alias("_part"))
    plays = cut(plays.filter("_plays > 0 or _part > 0"), "plays")
    rows = _named(docs).dropDuplicates(["doc_id", "_key", "source"]).join(plays, _same() & F.col("source").eqNullSafe(F.col("_source")))
    # a play of the whole document, or (once a source) of the words that its target has left
    play = F.explode(F.when(F.col("_part") > 0, F.sequence(F.lit(0), F.col("_plays").cast("int"))).otherwise(F.sequence(F.lit(1), F.col("_plays").cast("int"))))
    rows = rows.withColumn("_play", play).withColumn("text", F.when(F.col("_play") == 0, mixing.beginning(F.col("text"), F.col("_part"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_play") == 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), END_ID))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
