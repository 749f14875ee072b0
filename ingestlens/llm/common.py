"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts call white space: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run in one JVM (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: what follows neither recomputes ``df`` nor depends on the
    executor that made it. Fixed once written, so generated row numbers in it
    stay the same for every later reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``maybe``: true for all whose ``keys`` are in ``wanted`` and for few others.

    A Bloom filter of sixteen bits and more for every row of ``wanted``, three of
    one 64-bit word set by each, as a table of words; past 2**28 bits (64 MB as a
    table) it grows no more, but marks more rows and never misses one.
    """
    words = min(1 << 22, max(1 << 10, 1 << (wanted.count() // 4).bit_length()))
    key = F.xxhash64(*keys, F.lit("filter")).alias("__key")
    word = F.expr(f"__key & {words - 1}L")
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(__key, {k}) & 63 as int))" for k in (40, 46, 52)))
    filled = wanted.select(key).select(word.alias("__word"), bits.alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    placed = rows.select("*", key).withColumns({"__word": word, "__own": bits})
    there = F.coalesce(F.expr("__bits & __own = __own"), F.lit(False))
    return placed.join(F.broadcast(filled), "__word", "left").select(*rows.columns, there.alias("maybe"))


def maybe_among(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``, so that few are shuffled to it."""
    return marked(rows, wanted, *keys).filter("maybe").drop("maybe")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays. ``lower`` is faster but only right for plain ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc32_long(c: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as an unsigned number; a null counts as empty."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))
