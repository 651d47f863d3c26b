"""URL filters with a sorted digest array.

The list holds entries: rules (a host with all its subdomains, and a path
prefix) and exact URLs, each with a verdict.  An entry's key is a string -
``host/path`` of a rule, ``=url`` of an exact URL - and its digest the 64-bit
xxhash of that string.  Entries are dealt into shards by digest; a shard's
digests are sorted, written to a file and memory-mapped (the file is unlinked
at once, so nothing stays behind), probes are looked up by vectorised binary
search, and equal digests are confirmed against the stored full strings.

Each distinct URL probes ``=url`` and, for the numbers of host labels and the
path lengths that occur among the rules, every host suffix with every path
prefix; so the probes of a URL are bounded by the list, not by the URL's
length.  Probes are distinct keys, so a host or URL that holds a third of the
pages is looked up once.

The longest rule that fits gives the verdict, else the exact entry, else
``allow``.  Defined cases: a null URL or one without ``://`` has empty host
and path and is allowed; equal keys with different verdicts: ``block`` wins;
repeated rows keep their own result; empty tables give empty results.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import cut

SHARD_KEYS = 200_000
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOUND_SCHEMA = "key string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://``, A-Z lower-cased; path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *_AZ), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Sorted 64-bit digests in a memory-mapped file, with the full strings beside them."""

    def __init__(self, digests: np.ndarray, keys: list[str], values: list[str]):
        order = np.argsort(digests, kind="stable")
        self.n = len(order)
        with tempfile.TemporaryFile() as f:
            np.ascontiguousarray(digests[order], np.int64).tofile(f)
            f.flush()
            self.digests = np.memmap(f, np.int64, "r", shape=(self.n,)) if self.n else np.zeros(0, np.int64)
        self.keys = [keys[i] for i in order]
        self.values = [values[i] for i in order]

    def find(self, digests: np.ndarray, keys: list[str]) -> list[tuple[str, str]]:
        """(key, value) of the probes whose digest and full string are stored."""
        lo = np.searchsorted(self.digests, digests, side="left")
        hi = np.searchsorted(self.digests, digests, side="right")
        out = []
        for i in np.flatnonzero(hi > lo):
            out += [(keys[i], self.values[j]) for j in range(lo[i], hi[i]) if self.keys[j] == keys[i]]
        return out


def _lookup(listed: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    if not len(listed) or not len(probes):
        return pd.DataFrame({"key": [], "verdict": []}, dtype=str)
    array = DigestArray(listed.digest.to_numpy(), listed.key.tolist(), listed.verdict.tolist())
    return pd.DataFrame(array.find(probes.digest.to_numpy(), probes.key.tolist()), columns=["key", "verdict"])


def probe(listed: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """(key, verdict) of the ``keys`` that the list holds."""
    def dealt(df: DataFrame) -> DataFrame:
        digest = F.xxhash64("key")
        return df.withColumn("digest", digest).withColumn("shard", F.pmod(digest, F.lit(shards)))
    return (dealt(listed).groupBy("shard").cogroup(dealt(keys).groupBy("shard")).applyInPandas(_lookup, FOUND_SCHEMA))


def judge(df: DataFrame, url_col: str, rules: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """``df`` with host, path, rule and verdict, which take the place of columns of these names.

    rules: (host, path, verdict), path beginning with ``/``; exact: (url, verdict).
    """
    spark = df.sparkSession
    entries = rules.select(F.concat("host", "path").alias("key"), "verdict")
    if exact is not None:
        entries = entries.unionByName(exact.select(F.concat(F.lit("="), "url").alias("key"), "verdict"))
    entries = cut(entries.filter("key is not null").groupBy("key").agg(F.max("verdict").alias("verdict")), "url-list")
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    shape = shape.agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()  # sizes in the list only
    host, path = split_url(F.col("url"))
    urls = cut(df.select(F.col(url_col).alias("url")).filter("url is not null").distinct()
               .select("url", host.alias("host"), path.alias("path")), "urls")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(entries.count() + 4 * urls.count()) // SHARD_KEYS))
    known = F.size(F.split("host", r"\."))
    tries = [F.array(F.struct(F.concat(F.lit("="), "url").alias("key"), F.lit(0).alias("chars")))]
    for labels in shape["labels"]:
        for chars in shape["chars"]:
            key = F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars))
            fits = (known >= labels) & (F.length("path") >= chars) & (F.col("host") != "")
            tries.append(F.when(fits, F.array(F.struct(key.alias("key"), F.length(key).alias("chars")))).otherwise(F.array().cast("array<struct<key:string,chars:int>>")))
    probes = urls.select("url", F.explode(F.concat(*tries)).alias("p")).select("url", "p.*")
    found = cut(probe(entries, probes.select("key").distinct(), shards), "url-found")
    hits = (probes.join(found, "key").groupBy("url")
            .agg(F.max_by(F.struct("key", "verdict", "chars"), F.struct("chars", "key")).alias("_hit")))
    made = ("host", "path", "rule", "verdict")
    h, p = split_url(F.col("_url"))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], F.col(f"`{url_col}`").alias("_url"))
    rows = rows.join(hits.withColumnRenamed("url", "_url"), "_url", "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return rows.select(*kept, h.alias("host"), p.alias("path"), F.when(F.col("_hit.chars") > 0, F.col("_hit.key")).alias("rule"),
                       F.coalesce(F.col("_hit.verdict"), F.lit("allow")).alias("verdict"))
