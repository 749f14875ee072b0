"""Streaming operators as queries: the given events are streamed and the result is read when the stream has ended."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.operators.lifecycle import feed
from ingestlens.plans.replay import _OWNER, PASSED, STREAM_ROWS, fold_sql
from ingestlens.plans.views import SQL
from ingestlens.sources import auth_log
from ingestlens.streaming import first_files, metrics
from ingestlens.streaming.lifecycle import STATE_STORE, lifecycle_stream

#: How long a batch of the given files lives in the stream that forgets it.
LIFETIME_DAYS = 400
_KINDS = "case event_type when 'signup' then 'START' when 'purchase' then 'COMPLETE' when 'error' then 'ERROR' else 'UPLOAD' end"


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared place that the session names; a temporary one where none is set and all run in one JVM."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; by a glob, because the path may be a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    return _streamed(spark, sf_dir, "events")


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream over what is there now, written by it as files."""
    spark = stream.sparkSession
    place = _folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that the lifecycle needs, for the time in which a query starts and ends."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lif6(spark, sf_dir):
    with _state_store(spark):
        rows = finished(lifecycle_stream(feed(events_stream(spark, sf_dir))))
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


def str1(spark, sf_dir):
    rows = feed(events_stream(spark, sf_dir))
    return finished(metrics.metrics(rows)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n")


def str2(spark, sf_dir):
    rows = _streamed(spark, sf_dir, "lineitem")
    named = rows.select(
        F.col("l_orderkey").alias("batch_id"), F.concat(F.lit("part-"), F.col("l_linenumber").cast("string"), F.lit(".csv.gz")).alias("original_file_name"), F.col("l_shipdate").cast("timestamp").alias("uploaded_at")
    )
    return finished(metrics.first_files(named, "3650 days")).select("batch_id", "original_file_name")


def str2_lifetime(spark, sf_dir):
    rows = _streamed(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    named = rows.select(
        F.concat_ws("-", *map(text, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("file_id"), F.col("l_orderkey").alias("batch_id"),
        F.concat(F.lit("part-"), text("l_linenumber"), F.lit(".csv.gz")).alias("original_file_name"), F.col("l_shipdate").cast("timestamp").alias("uploaded_at"),
    )
    with _state_store(spark):
        out = finished(first_files.first_files(named, minutes=LIFETIME_DAYS * 1440))
    return out.select(F.col("batch_id").cast("long").alias("batch_id"), "original_file_name", "file_id")


def str1_outcomes(spark, sf_dir):
    rows = events_stream(spark, sf_dir)
    kinds = F.create_map(*[x for k, v in enumerate(("FileReadError", "ValidationError", "NetworkError", "ConfigurationError")) for x in (F.lit(k), F.lit(v))])
    errors = rows.filter("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("occurred_at"), kinds[(F.col("event_id") % 4).cast("int")].alias("type"))
    with _state_store(spark):
        out = finished(metrics.outcome_metrics(feed(rows), errors))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "measure", "kind", "n", "bytes")


def in_slices(spark: SparkSession, rows: DataFrame, n: int, file_rows: int = 100_000) -> DataFrame:
    """``rows`` as a stream of ``n`` micro-batches, equal stretches of ``t``, in order.

    Every slice has the same number of files, as many as the smallest can fill with ``file_rows`` each (one at least), which a micro-batch takes together.
    """
    place = f"{_folder(spark)}/slices"
    first, last = rows.agg(F.unix_micros(F.min("t")), F.unix_micros(F.max("t"))).first()
    nth = F.least(F.lit(n - 1), F.floor((F.unix_micros("t") - F.lit(first)) * n / F.lit((last or 0) - (first or 0) + 1)))
    placed = rows.withColumn("__slice", nth)
    sizes = {r["__slice"]: r["count"] for r in placed.groupBy("__slice").count().collect()}
    files = max(1, min(sizes.get(k, 0) for k in range(n)) // file_rows)
    for k in range(n):  # files are taken in order of their time
        part = placed.filter(F.col("__slice") == k).drop("__slice")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(place)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(place)


def _counted(spark: SparkSession, sf_dir: str, versions: int | None) -> str:
    place = _folder(spark)
    with _state_store(spark):
        owned = feed(spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet"))
        metrics.active_counts(lifecycle_stream(in_slices(spark, owned, 4)), f"{place}/counts", f"{place}/checkpoint", versions).start().awaitTermination()
    return f"{place}/counts"


def str4(spark, sf_dir):
    return metrics.current_counts(spark, _counted(spark, sf_dir, 2))


def str4_history(spark, sf_dir):
    return spark.read.parquet(_counted(spark, sf_dir, None)).filter("version > 0").select("version", "account_id", "active_batches")


#: A log line of an event, for Spark and DuckDB alike ({iso} is the time's text): lines that serve, failures with contexts
#: beside, below or only in the message, some without a time and some cut short.
_LINE = """case when event_id % 13 = 0 then '{{' else '{{"@timestamp":"' || {iso} || '",' end || case when event_type <> 'error' then '"level":"INFO","logger":"app","message":"served ' || event_id || '"}}'
  else '"level":"WARN","logger":"auth","new":{{"a":[1]}},"message":"auth_failure: Authentication failed for POST /' || (user_id % 3) || ' from 10.0.0.' || (user_id % 5)
    || case event_id % 3 when 0 then '","ip":"10.0.0.' || (user_id % 5) || ' , proxy","endpoint":"/' || (user_id % 3) || '","method":"POST","status":"401"}}'
                         when 1 then '","mdc":{{"ip":"10.0.0.' || (user_id % 5) || '","endpoint":"/' || (user_id % 3) || '","method":"POST","status":401}}}}' else '"}}' end end"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{_folder(spark)}/log"
    line = F.expr(_LINE.format(iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({c: F.col(c).cast("string") for c in ("event_type",)})
    cut = F.when(F.col("event_id") % 11 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    events.withColumn("line", line).select(cut.alias("value")).write.text(place)
    return auth_log.read_log(spark, place)


def str5(spark, sf_dir):
    out = finished(metrics.authentication_failures(auth_log.failures(_log(spark, sf_dir)), "1 day"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def str5_rejected(spark, sf_dir):
    return finished(auth_log.rejected_lines(_log(spark, sf_dir)))


QUERIES = {
    "lif6_lifecycle_stream": lif6,
    "str1_metric_stream": str1,
    "str1_outcome_metrics": str1_outcomes,
    "str2_first_files_stream": str2,
    "str2_first_files_of_lifetime": str2_lifetime,
    "str4_active_per_account": str4,
    "str4_active_history": str4_history,
    "str5_authentication_failures": str5,
    "str5_rejected_log_lines": str5_rejected,
}
#: A window is emitted when the watermark passes its end; ``availableNow`` ends with a batch that moves the watermark to 10 minutes before the last event.
_CLOSED = "(select max(ts) from events) - interval 10 minute"
#: The slower of two watermarks, in whole milliseconds; the last rows of every slice of time.
_BOTH = "(select date_trunc('milliseconds', least(max(ts), max(ts) filter (where event_type = 'error')) - interval 10 minute) from events)"
_SLICE = "least(3, floor((epoch_us(ts) - min(epoch_us(ts)) over ()) * 4 / (max(epoch_us(ts)) over () - min(epoch_us(ts)) over () + 1)))"
_SIGN = "case event when 'STARTED' then 1 else -1 end"
ORACLE_SQL = {
    "lif6_lifecycle_stream": fold_sql(until=PASSED) + STREAM_ROWS + "select * from rows_",
    "str4_active_per_account": fold_sql(account=_OWNER, until=PASSED) + STREAM_ROWS + f"select account_id, sum({_SIGN})::bigint active_batches from rows_ where event <> 'REJECTED' group by 1",
    "str4_active_history": fold_sql(account=_OWNER, until=PASSED)
    + STREAM_ROWS
    + f""", passed as (select nth + 1 as version, date_trunc('milliseconds', max(ts)) w from (select ts, {_SLICE} nth from events) group by 1)
    select version::bigint as version, account_id, sum({_SIGN})::bigint active_batches from passed join rows_ on "at" < w or ("at" = w and event <> 'NOT_COMPLETED') where event <> 'REJECTED' group by 1, 2""",
    "str1_metric_stream": f"select * from (select time_bucket(interval 1 hour, ts) window_start, {_KINDS} kind, count(*) n from events group by 1, 2) where window_start + interval 1 hour <= {_CLOSED}",
    "str1_outcome_metrics": fold_sql(until=_BOTH)
    + f""", found as (
      select "at", 'started' measure, null::varchar kind, null::bigint b from st where "action" = 'START' and reason is null
      union all select st."at", 'files', null, fsize from st join feed using (event_id) where st."action" = 'UPLOAD' and reason is null
      union all select ended_at, case status when 'COMPLETED' then 'completed' else 'expired' end, null, null from ended
      union all select b.started + interval 1 hour, 'expired', null, null from last_open where b.started + interval 1 hour < {_BOTH}
      union all select ts, 'errors', case event_id % 4 when 0 then 'FileReadError' when 1 then 'ValidationError' when 2 then 'NetworkError' else 'ConfigurationError' end, null from events where event_type = 'error')
    select time_bucket(interval 1 hour, "at") window_start, measure, kind, count(*) n, sum(b)::bigint bytes from found where time_bucket(interval 1 hour, "at") + interval 1 hour <= {_BOTH} group by 1, 2, 3""",
    "str2_first_files_stream": SQL + "select distinct batch_id, original_file_name from uploaded_files",
    "str2_first_files_of_lifetime": SQL.replace("with ", "with recursive ", 1)
    + f""", nth as (select *, row_number() over (partition by batch_id order by uploaded_at, file_id) n from uploaded_files),
    lives as (select batch_id, n, uploaded_at began from nth where n = 1
       union all select nth.batch_id, nth.n, case when uploaded_at > began + interval {LIFETIME_DAYS} day then uploaded_at else began end from lives join nth on nth.batch_id = lives.batch_id and nth.n = lives.n + 1)
    select batch_id, original_file_name, arg_min(file_id, n) file_id from nth join lives using (batch_id, n) group by batch_id, original_file_name, began""",
    "str5_authentication_failures": """with failed as (select * from events where event_type = 'error' and event_id % 11 <> 0 and event_id % 13 <> 0)
       select * from (select date_trunc('day', ts)::timestamp window_start, '10.0.0.'||(user_id % 5) address, '/'||(user_id % 3) endpoint, 'POST' "method", count(*) failures from failed group by all)
       where window_start + interval 1 day <= (select max(ts) from failed) - interval 10 minute""",
    "str5_rejected_log_lines": f"""with lines as (select event_id, {_LINE.format(iso="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')")} line, case when event_type <> 'error' then 'served '||event_id
         else 'auth_failure: Authentication failed for POST /'||(user_id % 3)||' from 10.0.0.'||(user_id % 5) end message from events)
       select case when event_id % 11 = 0 then 'BROKEN_JSON' else 'NO_TIME' end reason, case when event_id % 11 = 0 then line[:-4] else message end line from lines where event_id % 11 = 0 or event_id % 13 = 0""",
}
