"""Windowed metrics, file dedup, error ingest and activity counts over streams; all work on tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.schemas import CANCELLED, COMPLETED, FAILED, NOT_COMPLETED, TIMEOUT_MINUTES
from ingestlens.sources.partitions import append_errors
from ingestlens.streaming.lifecycle import lifecycle_stream

#: LIF6's rows by what they count as.
MEASURES = {"STARTED": "started", COMPLETED: "completed", FAILED: "failed", CANCELLED: "cancelled", NOT_COMPLETED: "expired", "UPLOADED": "files"}


def metrics(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", time: str = "t", kind: str = "action") -> DataFrame:
    """STR1: events per kind and tumbling window; rows later than ``delay`` are dropped and counted in the query's progress."""
    watched = events.withWatermark(time, delay) if events.isStreaming else events
    counted = watched.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "kind", "n")


def outcome_metrics(events: DataFrame, errors: DataFrame | None = None, width: str = "1 hour", delay: str = "10 minutes", minutes: int = TIMEOUT_MINUTES) -> DataFrame:
    """STR1: ``window_start, window_end, measure, kind, n, bytes``: batches started, completed, failed, cancelled and expired,
    files accepted (with their bytes), and errors by type (``kind``), in each window of event time.

    One stream: the lifecycle decides what is accepted and what expires, and
    hands its event time and watermark on to the windows, to which ``errors``
    (``occurred_at`` as TIMESTAMP, ``type``) come from their own stream; the
    watermark is the slower one's. A window is given once, when the watermark
    has passed its end: windows still open when a stream ends are not.
    """
    label = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])[F.col("event")]
    none = F.lit(None).cast("string")
    rows = lifecycle_stream(events, minutes=minutes, delay=delay, uploads=True, chained=True).filter(F.col("event") != "REJECTED")
    counted = rows.select(F.col("at").alias("time"), label.alias("measure"), none.alias("kind"), F.when(F.col("event") == "UPLOADED", F.col("bytes")).alias("bytes"))
    if errors is not None:
        logged = errors.withWatermark("occurred_at", delay)
        counted = counted.unionByName(logged.select(F.col("occurred_at").alias("time"), F.lit("errors").alias("measure"), F.col("type").alias("kind"), F.lit(None).cast("long").alias("bytes")))
    sums = counted.groupBy(F.window("time", width).alias("w"), "measure", "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "measure", "kind", "n", "bytes")


def first_files(files: DataFrame, delay: str = "60 minutes", time: str = "uploaded_at") -> DataFrame:
    """STR2: one file per name and batch. ``delay`` must not be shorter than a batch lives, or a late repeat passes."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(["batch_id", "original_file_name"])


def ingest_errors(errors: DataFrame, path: str, rejected_path: str, checkpoint: str):
    """STR3: a query that adds valid errors to SNK4's table of months, and rejected ones apart.

    A micro-batch adds only rows that the table has not, so one that is repeated
    adds nothing; ``partitions.compact`` joins the small files that many leave.
    """

    def write(rows: DataFrame, number: int) -> None:
        kept = rows.persist()  # read for its months, and for valid and rejected rows
        append_errors(kept, path, rejected_path)
        kept.unpersist()

    return errors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def active_per_account(lifecycle: DataFrame) -> DataFrame:
    """STR4: open batches per account that LIF6's rows add up to: +1 for a start, -1 for an end."""
    change = F.when(F.col("event") == "STARTED", 1).otherwise(-1)
    counted = lifecycle.filter(~F.col("event").isin("REJECTED", "UPLOADED"))
    return counted.groupBy("account_id").agg(F.sum(change).alias("active_batches"))


def add_changes(rows: DataFrame, number: int, path: str, versions: int | None = 2) -> None:
    """STR4: version ``number`` of the counts at ``path``: those of version ``number - 1`` and the changes in ``rows``."""
    place = lambda n: f"{path}/place={n if versions is None else n % versions}"
    total = active_per_account(rows)
    if number:
        before = rows.sparkSession.read.parquet(place(number - 1)).select("account_id", "active_batches")
        total = before.unionByName(total).groupBy("account_id").agg(F.sum("active_batches").alias("active_batches"))
    # A row an account: few, and one file a version.
    total.withColumn("version", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(place(number))


def active_counts(lifecycle: DataFrame, path: str, checkpoint: str, versions: int | None = 2):
    """STR4: a query that keeps the open batches per account up to date with LIF6's stream.

    Micro-batch N reads what N - 1 left, adds its own changes, reduced to a row
    an account before, and writes version N in overwrite mode: run again, it
    reads the same version and replaces its own, so nothing is counted twice.
    ``versions`` places are used in turn; with None all stay, as a history.
    """
    write = lambda rows, number: add_changes(rows, number, path, versions)
    return lifecycle.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """STR4: ``account_id, active_batches`` of the latest version."""
    kept = spark.read.parquet(path)
    latest = kept.agg(F.max("version").alias("version"))
    return kept.join(F.broadcast(latest), "version").select("account_id", "active_batches")


def authentication_failures(failed: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """STR5: failures (``auth_log.failures``) per address, endpoint and method in each window, given once the watermark has passed its end."""
    watched = failed.withWatermark("t", delay) if failed.isStreaming else failed
    counted = watched.groupBy(F.window("t", width).alias("w"), "address", "endpoint", "method").agg(F.count("*").alias("failures"))
    return counted.select(F.col("w.start").alias("window_start"), "address", "endpoint", "method", "failures")
