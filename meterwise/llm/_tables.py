"""Reading tables, cutting lineage and opening files in the shared folder."""

from __future__ import annotations

import posixpath

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path, ship

__all__ = ["cut", "cut_with", "shared_folder", "open_store", "table", "crc_mod", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back (survives lost executors)."""
    ship(df.sparkSession)
    return cut_lineage(df, f"llm-{name}")


def cut_with(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and aggregates of the rows taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), name)
    return out, seen.get


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a binary format, under ``spark.checkpoint.dir``."""
    return shared_path(spark, "files", name)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a shared folder; runs inside tasks (local mount, HDFS, S3, GCS)."""
    return pafs.FileSystem.from_uri(uri)


def join_path(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text modulo ``m``; a null value counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def text_key(col: Column) -> Column:
    """64-bit digest of a text; with the id it names a row's content, so repeated ids stay apart."""
    return F.xxhash64(F.coalesce(col, F.lit("")))
