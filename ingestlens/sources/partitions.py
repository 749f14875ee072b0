"""Month partitions of the error table: append, coverage, retention."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.operators.quality import validate


#: What makes an error row one row: the same twice, in one input or over several, is stored once.
KEY = ["error_id", "occurred_at"]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to ``path`` already; it is listed, not read."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path").take(1))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def new_rows(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """One row of each ``key`` in ``rows`` (with ``ym``) that the table at ``path`` has not yet.

    Only the months of ``rows`` and the key's columns are read of the table.
    """
    once, spark = rows.dropDuplicates([*key]), rows.sparkSession
    if not _exists(spark, path):
        return once
    months = [r["ym"] for r in rows.select("ym").distinct().collect()]  # as many as the input has months
    there = spark.read.parquet(path).filter(F.col("ym").isin(months)).select(*key)
    return once.join(there, key, "left_anti").select(*rows.columns)


def append_errors(errors: DataFrame, path: str, rejected_path: str | None = None, shredded: bool = False) -> None:
    """SNK4: valid errors added by month, sorted by site and time within a file; rejected ones apart.

    Can be repeated: rows whose :data:`KEY` the table has are not added again,
    so a job that failed half way, or ran twice, leaves the table as one run
    does. Rejected rows are told apart by all their columns. Two writers at a
    time are not told apart. Rows go to files by size, as adaptive execution
    measures it: a busy month, even of one site, is cut over tasks, and a small
    one is one file. ``shredded`` adds the metadata as the variant column
    ``metadata_v``, stored by field, for :func:`filters.metadata_is`.
    """
    valid, rejected = validate(errors, "error_logs")
    titled = valid.withColumn("title", F.coalesce("title", "type") if "title" in valid.columns else F.col("type"))
    placed = titled.withColumn("ym", S.month_key("occurred_at"))
    fresh = new_rows(placed, path, KEY)
    if shredded:
        fresh = fresh.withColumn("metadata_v", F.try_parse_json("metadata"))
    spread = fresh.hint("rebalance", "ym")
    spread.sortWithinPartitions("ym", "site_id", "occurred_at").write.mode("append").partitionBy("ym").parquet(path)
    if rejected_path:
        whole = rejected.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*rejected.columns), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["row_sha256"])
        if _exists(errors.sparkSession, rejected_path):
            whole = whole.join(errors.sparkSession.read.parquet(rejected_path).select("row_sha256"), "row_sha256", "left_anti").select(*rejected.columns, "row_sha256")
        whole.hint("rebalance").write.mode("append").parquet(rejected_path)


def compact(spark: SparkSession, path: str, files: int = 8) -> list[str]:
    """Rewrites the months of the table at ``path`` that have more than ``files`` files, and returns them.

    All rows of these months are first written beside the table, and only then
    replace its files, so what an interrupted replacement leaves out is still
    there. Files are listed, not read, to find the months.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    month = F.regexp_extract("path", r"/ym=([^/]+)/[^/]+$", 1)
    many = [r["ym"] for r in listed.select(month.alias("ym")).groupBy("ym").count().filter(F.col("count") > files).collect()]
    if many:
        stage = f"{path.rstrip('/')}-compacting-{uuid.uuid4().hex}"
        rows = spark.read.parquet(path).filter(F.col("ym").isin(many))
        rows.hint("rebalance", "ym").sortWithinPartitions("ym", "site_id", "occurred_at").write.partitionBy("ym").parquet(stage)
        spark.read.parquet(stage).hint("rebalance", "ym").sortWithinPartitions("ym", "site_id", "occurred_at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)
    return sorted(many)


def _present(errors: DataFrame) -> DataFrame:
    months = F.col("ym") if "ym" in errors.columns else S.month_key("occurred_at")
    return errors.select(months.alias("ym")).distinct()


def coverage(errors: DataFrame, start: datetime, as_of: datetime) -> DataFrame:
    """PAR1: every month from ``start`` to the one after ``as_of``, and whether it has rows."""
    spark = errors.sparkSession
    first, last = F.lit(start).cast("date"), F.lit(as_of).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(S.month_start(first), S.next_month(last), F.expr("interval 1 month"))).alias("d"))
    wanted = months.select(S.month_key("d").alias("ym"))
    return wanted.join(_present(errors).withColumn("present", F.lit(True)), "ym", "left").fillna(False, ["present"])


def retained(errors: DataFrame, as_of: datetime, months: int) -> DataFrame:
    """PAR2: the rows of months after the cutoff; every month up to it goes, not only the one that is due."""
    cutoff = S.month_key(S.retention_cutoff(F.lit(as_of).cast("date"), months))
    own = F.col("ym") if "ym" in errors.columns else S.month_key("occurred_at")
    return errors.filter(own > cutoff)


def drop_expired(errors: DataFrame, as_of: datetime, months: int, path: str) -> None:
    """PAR2: the retained months written to a new place; the one that is read is never overwritten."""
    kept = retained(errors, as_of, months)
    if "ym" not in kept.columns:
        kept = kept.withColumn("ym", S.month_key("occurred_at"))
    kept.write.partitionBy("ym").parquet(path)


def create_table(errors: DataFrame, table: str) -> None:
    """Errors (valid ones, as SNK4 stores them) as the table ``table`` of the catalog, by month, for :func:`drop_months`."""
    rows = errors if "ym" in errors.columns else errors.withColumn("ym", S.month_key("occurred_at"))
    rows.hint("rebalance", "ym").sortWithinPartitions("ym", "site_id", "occurred_at").write.partitionBy("ym").format("parquet").saveAsTable(table)


def drop_months(spark: SparkSession, table: str, as_of: datetime, months: int) -> list[str]:
    """PAR2: drops the expired months of a catalog table and returns them; no data file is read, none of a kept month is written.

    The months come from the catalog. Done again, it finds nothing to drop.
    """
    cutoff = spark.range(1).select(S.month_key(S.retention_cutoff(F.lit(as_of).cast("date"), months))).first()[0]
    present = [r[0].partition("=")[2] for r in spark.sql(f"show partitions {table}").collect()]
    expired = sorted(m for m in present if m != "__HIVE_DEFAULT_PARTITION__" and m <= cutoff)
    if expired:
        spark.sql(f"alter table {table} drop if exists " + ", ".join(f"partition (ym = '{m}')" for m in expired))
    return expired
