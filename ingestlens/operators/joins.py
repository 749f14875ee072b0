"""Joins and views. Facts are reduced to the key of the join before it wherever they fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S

FILE_VIEW = ["file_id", "original_file_name", "file_size", "content_type", "checksum", "uploaded_at"]


def files_by(files: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """JOI1 (``account_id``) and JOI2 (``site_id``): files and bytes per key, summed per batch before the join."""
    per_batch = files.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    joined = per_batch.join(batches.select("batch_id", key), "batch_id")
    return joined.groupBy(key).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def with_domain(df: DataFrame, sites: DataFrame) -> DataFrame:
    """JOI3 (batches) and JOI9 (errors): the site's domain, ``unknown`` where the site is missing."""
    named = df.drop("domain").join(sites.select("site_id", "domain"), "site_id", "left")
    return named.withColumn("domain", S.or_default("domain", "unknown"))


def batch_details(batches: DataFrame, files: DataFrame, sites: DataFrame) -> DataFrame:
    """JOI4: a row per batch with its files, oldest first, nested; a batch holds at most its quota of files."""
    fields = [c for c in FILE_VIEW if c in files.columns]
    order = [c for c in ("uploaded_at", "file_id") if c in fields]
    entry = F.struct(*order, *[c for c in fields if c not in order])
    nested = files.groupBy("batch_id").agg(F.sort_array(F.collect_list(entry)).alias("files"))
    return with_domain(batches, sites).join(nested, "batch_id", "left").withColumn("files", F.coalesce("files", F.array().cast(nested.schema["files"].dataType)))


def foreign_errors(errors: DataFrame, batches: DataFrame) -> DataFrame:
    """JOI5: errors filed against another site's batch."""
    owner = batches.select("batch_id", F.col("site_id").alias("batch_site_id"))
    return errors.join(owner, "batch_id").filter("site_id <> batch_site_id")


def eligible_sites(sites: DataFrame, accounts: DataFrame) -> DataFrame:
    """JOI6: active sites of active accounts."""
    return sites.filter("is_active").join(accounts.filter("is_active").select("account_id"), "account_id", "left_semi")


def with_account(batches: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOI7: batches with their site's account, and those whose site is missing."""
    joined = batches.drop("account_id").join(sites.select("site_id", "account_id"), "site_id", "left")
    return joined.filter("account_id is not null"), joined.filter("account_id is null").drop("account_id")


def errors_per_account(errors: DataFrame, sites: DataFrame) -> DataFrame:
    """JOI8: summed per site before the join."""
    per_site = errors.groupBy("site_id").agg(F.count("*").alias("errors"))
    return per_site.join(sites.select("site_id", "account_id"), "site_id").groupBy("account_id").agg(F.sum("errors").alias("errors"))


def account_drift(batches: DataFrame, sites: DataFrame) -> DataFrame:
    """JOI10: batches whose copy of the account is not their site's."""
    owner = sites.select("site_id", F.col("account_id").alias("site_account_id"))
    return batches.join(owner, "site_id").filter("account_id <> site_account_id")


def account_view(accounts: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """PRJ1: with counts of sites, batches and files where statistics are given."""
    view = accounts.select([c for c in ("account_id", "email", "name", "is_active", "created_at", "updated_at") if c in accounts.columns])
    if stats is None:
        return view
    return view.join(stats.select("account_id", F.col("sites").alias("sites_count"), F.col("batches").alias("batches_count"), F.col("files").alias("files_count")), "account_id", "left")


def site_view(sites: DataFrame) -> DataFrame:
    """PRJ2: without any secret."""
    return sites.select([c for c in ("site_id", "account_id", "domain", "display_name", "is_active", "created_at", "updated_at") if c in sites.columns])


def batch_view(batches: DataFrame) -> DataFrame:
    """PRJ3: the id under both its names, the status as text."""
    wanted = ("site_id", "status", "s3_path", "uploaded_files_count", "total_size", "has_errors", "started_at", "completed_at")
    return batches.select(F.col("batch_id").alias("id"), "batch_id", *[F.col(c).cast("string").alias(c) if c == "status" else F.col(c) for c in wanted if c in batches.columns])


def batch_summary(batches: DataFrame, sites: DataFrame) -> DataFrame:
    """PRJ4."""
    wanted = ("batch_id", "site_id", "domain", "status", "s3_path", "uploaded_files_count", "total_size", "has_errors", "started_at", "completed_at", "created_at")
    named = with_domain(batches, sites)
    return named.select([c for c in wanted if c in named.columns])


def error_view(errors: DataFrame, summary: bool = False) -> DataFrame:
    """PRJ5; the summary leaves the metadata out. The title is the type where there is none."""
    titled = errors.withColumn("title", F.coalesce("title", "type") if "title" in errors.columns else F.col("type"))
    wanted = ["error_id", "site_id", "batch_id", "type", "title", "message", "metadata", "occurred_at"]
    return titled.select([c for c in wanted if c in titled.columns and not (summary and c == "metadata")])


def file_view(files: DataFrame) -> DataFrame:
    """PRJ6."""
    return files.select([c for c in FILE_VIEW if c in files.columns])


def with_storage_path(batches: DataFrame, sites: DataFrame) -> DataFrame:
    """PRJ7: the path computed from account, domain and start."""
    return with_domain(batches, sites).withColumn("s3_path", S.storage_path("account_id", "domain", "started_at"))


def with_object_key(files: DataFrame, batches: DataFrame) -> DataFrame:
    """PRJ8."""
    return files.drop("s3_key").join(batches.select("batch_id", "s3_path"), "batch_id").withColumn("s3_key", S.object_key("s3_path", "original_file_name"))
