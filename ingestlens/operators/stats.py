"""Counts and statistics. Each fact is reduced to the wanted grain before any join, so nothing is counted twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.operators.joins import errors_per_account, files_by
from ingestlens.schemas import COMPLETED, FAILED, IN_PROGRESS


def _status(status: str, name: str) -> Column:
    return F.count_if(F.col("status") == status).alias(name)


def _outer(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """``base`` with every part; missing counts are 0."""
    joined = reduce(lambda a, b: a.join(b, key, "left"), parts, base)
    counts = [f.name for p in parts for f in p.schema if f.dataType.typeName() in ("long", "integer")]
    flags = [f.name for p in parts for f in p.schema if f.dataType.typeName() == "boolean"]
    return joined.fillna(0, counts).fillna(False, flags)


def batches_per_account(batches: DataFrame) -> DataFrame:
    """AGG1."""
    return batches.groupBy("account_id").agg(F.count("*").alias("batches"), _status(IN_PROGRESS, "active_batches"))


def counts_per_site(batches: DataFrame, files: DataFrame, errors: DataFrame, sites: DataFrame) -> DataFrame:
    """AGG2: batches, files and errors."""
    per_site = batches.groupBy("site_id").agg(F.count("*").alias("batches"))
    return _outer(
        sites.select("site_id"),
        [per_site, files_by(files, batches, "site_id").drop("bytes"), errors.groupBy("site_id").agg(F.count("*").alias("errors"))],
        "site_id",
    )


def counts_per_batch(batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """AGG3: files and errors; standalone errors count nowhere."""
    return _outer(
        batches.select("batch_id"),
        [files.groupBy("batch_id").agg(F.count("*").alias("files")), errors.filter("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("errors"))],
        "batch_id",
    )


def sites_per_account(sites: DataFrame) -> DataFrame:
    """AGG4."""
    return sites.groupBy("account_id").agg(F.count("*").alias("sites"), F.count_if("is_active").alias("active_sites"))


def active_batches(batches: DataFrame) -> DataFrame:
    """AGG5."""
    return batches.agg(_status(IN_PROGRESS, "active_batches"))


def account_statistics(accounts: DataFrame, sites: DataFrame, batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """STA1: a row per account, zeros where it has nothing."""
    per_batch = files.groupBy("batch_id").agg(F.count("*").alias("f"), F.sum("file_size").alias("b"), F.max("uploaded_at").alias("last"))
    of_batches = (
        batches.select("batch_id", "account_id", "status")
        .join(per_batch, "batch_id", "left")
        .groupBy("account_id")
        .agg(
            F.count("*").alias("batches"),
            _status(IN_PROGRESS, "active_batches"),
            _status(COMPLETED, "completed_batches"),
            _status(FAILED, "failed_batches"),
            F.coalesce(F.sum("f"), F.lit(0)).alias("files"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
            F.max("last").alias("last_upload_at"),
        )
    )
    return _outer(accounts.select("account_id"), [sites_per_account(sites), of_batches, errors_per_account(errors, sites)], "account_id")


def global_statistics(accounts: DataFrame, sites: DataFrame, batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """STA2: one row; each side of the cross joins is a single row."""
    parts = [
        accounts.agg(F.count("*").alias("accounts"), F.count_if("is_active").alias("active_accounts")),
        sites.agg(F.count("*").alias("sites"), F.count_if("is_active").alias("active_sites")),
        batches.agg(F.count("*").alias("batches"), _status(IN_PROGRESS, "active_batches"), _status(COMPLETED, "completed_batches"), _status(FAILED, "failed_batches")),
        files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")),
        errors.agg(F.count("*").alias("errors")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def site_statistics(sites: DataFrame, batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """STA3."""
    of_batches = batches.groupBy("site_id").agg(
        F.count("*").alias("batches"),
        _status(COMPLETED, "completed_batches"),
        _status(FAILED, "failed_batches"),
        F.bool_or(F.col("status") == IN_PROGRESS).alias("has_active_batch"),
    )
    return _outer(
        sites.select("site_id", "account_id"),
        [of_batches, files_by(files, batches, "site_id"), errors.groupBy("site_id").agg(F.count("*").alias("errors"))],
        "site_id",
    )


def batch_statistics(batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """STA4."""
    return batches.select("batch_id", "site_id", "status").join(counts_per_batch(batches, files, errors), "batch_id")


def all_levels(batches: DataFrame, files: DataFrame) -> DataFrame:
    """STA5: platform, account and site in one pass; ``level`` 0 is a site, 1 an account, 3 everything."""
    per_batch = files.groupBy("batch_id").agg(F.count("*").alias("f"), F.sum("file_size").alias("b"))
    joined = batches.select("batch_id", "account_id", "site_id", "status").join(per_batch, "batch_id", "left")
    return joined.groupingSets([[], [F.col("account_id")], [F.col("account_id"), F.col("site_id")]], F.col("account_id"), F.col("site_id")).agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("batches"),
        _status(IN_PROGRESS, "active_batches"),
        _status(COMPLETED, "completed_batches"),
        _status(FAILED, "failed_batches"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
    )


def derived_counters(batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """STA6: what a batch's counters must be; the error flag stays once any error or failure set it."""
    of_files = files.groupBy("batch_id").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("byte_count"))
    with_error = errors.filter("batch_id is not null").select("batch_id").distinct().withColumn("any_error", F.lit(True))
    joined = _outer(batches.select("batch_id", "status"), [of_files, with_error], "batch_id")
    return joined.select("batch_id", "file_count", "byte_count", (F.col("any_error") | (F.col("status") == FAILED)).alias("has_errors"))


def counter_drift(batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """STA7: batches whose stored counters differ from the derived ones, and files of batches that do not exist."""
    derived = derived_counters(batches, files, errors).withColumnRenamed("has_errors", "derived_errors")
    orphans = files.join(batches.select("batch_id"), "batch_id", "left_anti").groupBy("batch_id").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("byte_count"))
    known = derived.unionByName(orphans.withColumn("derived_errors", F.lit(None).cast("boolean")))
    stored = batches.select("batch_id", F.col("uploaded_files_count").cast("long").alias("stored_files"), F.col("total_size").alias("stored_bytes"), F.col("has_errors").alias("stored_errors"))
    both = stored.join(known, "batch_id", "full")
    same = F.col("stored_files").eqNullSafe(F.col("file_count")) & F.col("stored_bytes").eqNullSafe(F.col("byte_count")) & F.col("stored_errors").eqNullSafe(F.col("derived_errors"))
    delta = lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))
    return both.filter(~same).select("*", delta("stored_files", "file_count").alias("files_delta"), delta("stored_bytes", "byte_count").alias("bytes_delta"))


def errors_by_type(errors: DataFrame, unit: str | None = None) -> DataFrame:
    """STA8: in all, or per ``day`` or ``month``."""
    keys = ["type"] + ([F.date_trunc(unit, "occurred_at").cast("timestamp_ntz").alias("period")] if unit else [])
    return errors.groupBy(*keys).agg(F.count("*").alias("errors"))


def outcomes(batches: DataFrame, exact: bool = False) -> DataFrame:
    """STA9: batches per status, share of all, and the ended ones' durations in seconds (average, median, 95th percentile).

    Percentiles are approximate (to a ten thousandth of the rank), so that a
    status is merged from small sketches; ``exact`` ones keep every distinct
    duration of a status in one task.
    """
    at = (lambda p: F.percentile("s", p)) if exact else (lambda p: F.percentile_approx("s", p, 10_000))
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    per = batches.select("status", seconds.alias("s")).groupBy("status").agg(
        F.count("*").alias("batches"), F.avg("s").alias("avg_seconds"), at(0.5).alias("p50_seconds"), at(0.95).alias("p95_seconds")
    )
    total = batches.agg(F.count("*").alias("total"))
    return per.crossJoin(total).withColumn("share", F.col("batches") / F.col("total")).drop("total")


def success_share(batches: DataFrame) -> DataFrame:
    """STA9: completed batches among the ended ones."""
    ended = F.count_if(F.col("status") != IN_PROGRESS)
    return batches.agg(ended.alias("ended"), _status(COMPLETED, "completed_batches"), F.try_divide(F.count_if(F.col("status") == COMPLETED), ended).alias("success_share"))


def uploads_per_day(files: DataFrame) -> DataFrame:
    """STA10."""
    return files.groupBy(F.date_trunc("day", "uploaded_at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def storage_per_account(files: DataFrame, batches: DataFrame) -> DataFrame:
    """STA10."""
    return files_by(files, batches, "account_id").select("account_id", "bytes")


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """STA11."""
    return df.agg(F.count("*").alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size))
