"""The given tables seen as accounts, sites, batches, files and errors.

``model`` builds the views with DataFrames, ``SQL`` states the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.functions.scalars import storage_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("account_id"),
        F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 7 != 0).alias("is_active"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_nationkey") % 5).cast("timestamp_ntz").alias("created_at"),
    )


def sites(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("site_id"),
        F.col("c_nationkey").cast("long").alias("account_id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias("domain"),
        F.col("c_name").alias("display_name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.date_add(F.lit("2000-02-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("timestamp_ntz").alias("created_at"),
    )


def batches(spark, sf_dir):
    o, s = _table(spark, sf_dir, "orders"), sites(spark, sf_dir).select("site_id", "account_id", "domain")
    p = F.col("o_orderpriority")
    status = (
        F.when(F.col("o_orderstatus") == "O", "IN_PROGRESS")
        .when(F.col("o_orderstatus") == "P", "NOT_COMPLETED")
        .when(p == "1-URGENT", "FAILED")
        .when(p == "5-LOW", "CANCELLED")
        .otherwise("COMPLETED")
    )
    started = F.col("o_orderdate").cast("timestamp_ntz")
    rows = o.select(
        F.col("o_orderkey").alias("batch_id"),
        F.col("o_custkey").alias("site_id"),
        status.alias("status"),
        (F.col("o_orderkey") % 7).cast("int").alias("uploaded_files_count"),
        F.col("o_totalprice").cast("long").alias("total_size"),
        started.alias("started_at"),
        F.when(status != "IN_PROGRESS", started + F.make_dt_interval(mins=(F.col("o_orderkey") % 120).cast("int"))).alias("completed_at"),
    )
    return (
        rows.join(s, "site_id")
        .withColumn("has_errors", F.col("status") == "FAILED")
        .withColumn("s3_path", storage_path("account_id", "domain", "started_at"))
    )


def files(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    return li.select(
        F.concat_ws("-", *map(text, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("file_id"),
        F.col("l_orderkey").alias("batch_id"),
        F.concat(F.lit("part-"), text("l_linenumber"), F.lit(".csv.gz")).alias("original_file_name"),
        (F.col("l_quantity").cast("long") * 1024 + F.col("l_linenumber")).alias("file_size"),
        F.md5(F.concat_ws("-", text("l_partkey"), text("l_suppkey"))).alias("checksum"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("uploaded_at"),
    )


def errors(spark, sf_dir):
    e = _table(spark, sf_dir, "events").filter("event_type = 'error'")
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("FileReadError", "ValidationError", "NetworkError", "ConfigurationError")))
    return e.select(
        i.alias("error_id"),
        F.col("user_id").alias("site_id"),
        F.when(i % 5 != 0, i * 7 % 1500).alias("batch_id"),
        F.element_at(kinds, (i % 4 + 1).cast("int")).alias("type"),
        F.concat(F.lit("event "), i.cast("string"), F.when(i % 3 == 0, ', "quoted"').otherwise("")).alias("message"),
        F.col("props").alias("metadata"),
        (F.col("ts").cast("timestamp_ntz") - F.make_dt_interval(days=(i % 36 * 30).cast("int"))).alias("occurred_at"),
    )


def model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f.__name__: f(spark, sf_dir) for f in (accounts, sites, batches, files, errors)}


SQL = """with accounts as (
  select cast(n_nationkey as bigint) account_id, lower(n_name)||'@example.com' email, n_name as name, n_nationkey % 7 <> 0 is_active,
         timestamp '2000-01-01' + to_days(n_nationkey % 5) created_at from nation),
sites as (
  select c_custkey site_id, cast(c_nationkey as bigint) account_id, lower(replace(c_name,'#','-'))||'.example.com' as "domain",
         c_name display_name, c_acctbal >= 0 is_active, timestamp '2000-02-01' + to_days(cast(c_custkey % 300 as integer)) created_at from customer),
batches0 as (
  select o_orderkey batch_id, o_custkey site_id,
         case when o_orderstatus='O' then 'IN_PROGRESS' when o_orderstatus='P' then 'NOT_COMPLETED' when o_orderpriority='1-URGENT' then 'FAILED'
              when o_orderpriority='5-LOW' then 'CANCELLED' else 'COMPLETED' end status,
         cast(o_orderkey % 7 as integer) uploaded_files_count, cast(trunc(o_totalprice) as bigint) total_size, o_orderdate started_at from orders),
batches as (
  select b.*, s.account_id, s."domain", case when status <> 'IN_PROGRESS' then started_at + to_minutes(batch_id % 120) end completed_at, status = 'FAILED' has_errors,
         s.account_id||'/'||s."domain"||'/'||strftime(started_at, '%Y-%m-%d/%H-%M')||'/' s3_path
  from batches0 b join sites s using (site_id)),
uploaded_files as (
  select l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey file_id, l_orderkey batch_id, 'part-'||l_linenumber||'.csv.gz' original_file_name,
         cast(l_quantity as bigint)*1024+l_linenumber file_size, md5(l_partkey||'-'||l_suppkey) checksum, l_shipdate uploaded_at from lineitem),
error_logs as (
  select event_id error_id, user_id site_id, case when event_id % 5 = 0 then null else event_id*7 % 1500 end batch_id,
         case event_id % 4 when 0 then 'FileReadError' when 1 then 'ValidationError' when 2 then 'NetworkError' else 'ConfigurationError' end as type,
         'event '||event_id||case when event_id % 3 = 0 then ', "quoted"' else '' end message, props metadata, ts - to_days(cast(event_id % 36 * 30 as integer)) occurred_at
  from events where event_type='error')
"""
