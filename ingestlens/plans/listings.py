"""Queries over filters, joins, views, statistics and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.operators import filters, joins, paging, stats
from ingestlens.plans.views import SQL, model

AS_OF = datetime(2001, 7, 1)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None):
    """Registers ``f(m, spark, sf_dir)`` under ``name`` with its SQL over the views."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(model(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = SQL + sql
        return f

    return add


def _add(name: str, sql: str, f) -> None:
    query(name, sql)(f)


# Filters
_add("fil1_batch_by_id", "select * from batches where batch_id = 17", lambda m: filters.by_id(m["batches"], "batch_id", 17))
_add("fil1_sites_by_ids", "select * from sites where site_id in (select site_id from error_logs)", lambda m: filters.by_ids(m["sites"], m["errors"], "site_id"))
_add("fil2_account_by_email", "select * from accounts where lower(email) = lower('Nation_3@Example.COM')", lambda m: filters.by_text(m["accounts"], "email", "Nation_3@Example.COM"))
_add(
    "fil3_existing_domains",
    """select upper("domain") as "domain" from sites where site_id % 3 = 0""",
    lambda m: filters.existing(
        m["sites"].select(F.when(F.col("site_id") % 3 == 0, F.upper("domain")).otherwise(F.concat(F.lit("no-"), F.col("domain"))).alias("domain")), m["sites"], "domain"
    ),
)
_add("fil4_active_accounts", "select * from accounts where is_active", lambda m: filters.active_accounts(m["accounts"]))
_add("fil5_sites_of_account", "select * from sites where account_id = 4 and is_active", lambda m: filters.sites_of(m["sites"], 4, active_only=True))
_add("fil6_open_batches", "select * from batches where status = 'IN_PROGRESS'", lambda m: filters.open_batches(m["batches"]))
_add(
    "fil7_expired_batches",
    "select * from batches where status = 'IN_PROGRESS' and started_at < timestamp '2001-07-01' - interval 60 minute",
    lambda m: filters.expired(m["batches"], AS_OF),
)
_add("fil8_batches_by_status", "select * from batches where status = 'FAILED'", lambda m: filters.batch_list(m["batches"], status="FAILED"))
_add(
    "fil9_errors_by_site_and_type",
    "select * from error_logs where type = 'NetworkError' and site_id = 8",
    lambda m: filters.error_list(m["errors"], site=8, type_="NetworkError"),
)
_add(
    "fil10_errors_in_range",
    "select * from error_logs where occurred_at >= timestamp '2022-06-01' and occurred_at < timestamp '2022-09-01' and type = 'ValidationError'",
    lambda m: filters.error_filter(m["errors"], None, "ValidationError", datetime(2022, 6, 1), datetime(2022, 9, 1)),
)
_add("fil11_export_filter", "select * from error_logs where occurred_at >= timestamp '2023-01-01'", lambda m: filters.error_filter(m["errors"], start=datetime(2023, 1, 1)))
_add("fil12_errors_of_batch", "select * from error_logs where batch_id = 14", lambda m: filters.errors_of(m["errors"], "batch_id", 14))
_add("fil13_files_of_batch", "select * from uploaded_files where batch_id = 5", lambda m: filters.files_of(m["files"], 5))
_add(
    "fil14_names_in_batch",
    "select batch_id, 'part-1.csv.gz' original_file_name from batches b where exists (select 1 from uploaded_files f where f.batch_id = b.batch_id and original_file_name = 'part-1.csv.gz')",
    lambda m: filters.already_uploaded(m["batches"].select("batch_id", F.lit("part-1.csv.gz").alias("original_file_name")), m["files"]),
)
_add(
    "fil15_errors_in_scope",
    "select * from error_logs where site_id in (select site_id from sites where account_id = 3)",
    lambda m: filters.in_scope(m["errors"], filters.sites_of(m["sites"], 3)),
)
_add(
    "fil16_status_predicates",
    "select batch_id, status = 'IN_PROGRESS' accepts, status <> 'IN_PROGRESS' ended from batches",
    lambda m: m["batches"].select("batch_id", filters.accepts_upload().alias("accepts"), filters.is_terminal().alias("ended")),
)
_add("fil17_metadata_value", "select * from error_logs where cast(json_extract(metadata, '$.k') as integer) = 42", lambda m: filters.metadata_is(m["errors"], "$.k", 42, "int"))

# Joins and views
_add(
    "joi1_files_per_account",
    "select account_id, count(*) files, cast(sum(file_size) as bigint) bytes from uploaded_files join batches using (batch_id) group by 1",
    lambda m: joins.files_by(m["files"], m["batches"], "account_id"),
)
_add(
    "joi2_files_per_site",
    "select site_id, count(*) files, cast(sum(file_size) as bigint) bytes from uploaded_files join batches using (batch_id) group by 1",
    lambda m: joins.files_by(m["files"], m["batches"], "site_id"),
)
_add(
    "joi3_batches_with_domain",
    """select batch_id, site_id, status, coalesce(s."domain", 'unknown') as "domain" from batches b left join (select site_id, "domain" from sites where site_id % 10 <> 0) s using (site_id)""",
    lambda m: joins.with_domain(m["batches"].select("batch_id", "site_id", "status"), m["sites"].filter("site_id % 10 <> 0")),
)
_add(
    "joi4_batch_details",
    """select batch_id, b."domain", coalesce(string_agg(file_id||':'||file_size, ',' order by uploaded_at, file_id, original_file_name, file_size), '') files
       from batches b left join uploaded_files f using (batch_id) group by 1, 2""",
    lambda m: joins.batch_details(m["batches"].select("batch_id", "site_id"), m["files"], m["sites"]).select(
        "batch_id", "domain", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file_id"], f["file_size"].cast("string"))), ",").alias("files")
    ),
)
_add(
    "joi5_foreign_errors",
    "select e.*, b.site_id batch_site_id from error_logs e join batches b using (batch_id) where e.site_id <> b.site_id",
    lambda m: joins.foreign_errors(m["errors"], m["batches"]),
)
_add(
    "joi6_eligible_sites",
    "select * from sites s where is_active and exists (select 1 from accounts a where a.account_id = s.account_id and a.is_active)",
    lambda m: joins.eligible_sites(m["sites"], m["accounts"]),
)
_add(
    "joi7_account_on_batches",
    "select batch_id, site_id, s.account_id from batches join (select * from sites where site_id % 9 <> 0) s using (site_id)",
    lambda m: joins.with_account(m["batches"].select("batch_id", "site_id"), m["sites"].filter("site_id % 9 <> 0"))[0],
)
_add(
    "joi8_errors_per_account",
    "select account_id, count(*) errors from error_logs join sites using (site_id) group by 1",
    lambda m: joins.errors_per_account(m["errors"], m["sites"]),
)
_add(
    "joi9_errors_with_domain",
    """select error_id, site_id, coalesce("domain", 'unknown') as "domain" from error_logs left join sites using (site_id)""",
    lambda m: joins.with_domain(m["errors"].select("error_id", "site_id"), m["sites"]),
)
_add(
    "joi10_account_drift",
    "select batch_id, case when batch_id % 11 = 0 then account_id + 1 else account_id end account_id, account_id site_account_id from batches where batch_id % 11 = 0",
    lambda m: joins.account_drift(
        m["batches"].select("batch_id", "site_id", F.when(F.col("batch_id") % 11 == 0, F.col("account_id") + 1).otherwise(F.col("account_id")).alias("account_id")), m["sites"]
    ).drop("site_id"),
)
_STA1 = """, per_batch as (select batch_id, count(*) f, sum(file_size) b, max(uploaded_at) l from uploaded_files group by 1),
ba as (select account_id, count(*) batches, count(*) filter (status='IN_PROGRESS') active_batches, count(*) filter (status='COMPLETED') completed_batches,
         count(*) filter (status='FAILED') failed_batches, sum(f) files, sum(b) bytes, max(l) last_upload_at from batches left join per_batch using (batch_id) group by 1),
si as (select account_id, count(*) sites, count(*) filter (is_active) active_sites from sites group by 1),
er as (select account_id, count(*) errors from error_logs join sites using (site_id) group by 1),
sta1 as (select account_id, coalesce(sites,0) sites, coalesce(active_sites,0) active_sites, coalesce(batches,0) batches, coalesce(active_batches,0) active_batches,
  coalesce(completed_batches,0) completed_batches, coalesce(failed_batches,0) failed_batches, cast(coalesce(files,0) as bigint) files, cast(coalesce(bytes,0) as bigint) bytes,
  last_upload_at, coalesce(errors,0) errors from accounts left join si using (account_id) left join ba using (account_id) left join er using (account_id))
"""
_ALL = ("accounts", "sites", "batches", "files", "errors")
_sta1 = lambda m: stats.account_statistics(*(m[k] for k in _ALL))
_add(
    "prj1_accounts_with_counts",
    _STA1 + "select a.*, sites sites_count, batches batches_count, files files_count from accounts a join sta1 using (account_id)",
    lambda m: joins.account_view(m["accounts"], _sta1(m)),
)
_add("prj2_sites", "select * from sites", lambda m: joins.site_view(m["sites"]))
_add(
    "prj3_batches",
    "select batch_id id, batch_id, site_id, status, s3_path, uploaded_files_count, total_size, has_errors, started_at, completed_at from batches",
    lambda m: joins.batch_view(m["batches"]),
)
_add(
    "prj4_batch_summaries",
    """select batch_id, site_id, "domain", status, s3_path, uploaded_files_count, total_size, has_errors, started_at, completed_at from batches""",
    lambda m: joins.batch_summary(m["batches"], m["sites"]),
)
_add("prj5_error_summaries", "select error_id, site_id, batch_id, type, type title, message, occurred_at from error_logs", lambda m: joins.error_view(m["errors"], summary=True))
_add("prj6_files", "select file_id, original_file_name, file_size, checksum, uploaded_at from uploaded_files", lambda m: joins.file_view(m["files"]))
_add("prj7_storage_paths", "select batch_id, s3_path from batches", lambda m: joins.with_storage_path(m["batches"].drop("s3_path"), m["sites"]).select("batch_id", "s3_path"))
_add(
    "prj8_object_keys",
    "select file_id, s3_path||original_file_name s3_key from uploaded_files join batches using (batch_id)",
    lambda m: joins.with_object_key(m["files"], m["batches"]).select("file_id", "s3_key"),
)

# Counts and statistics
_add("agg1_batches_per_account", "select account_id, count(*) batches, count(*) filter (status='IN_PROGRESS') active_batches from batches group by 1", lambda m: stats.batches_per_account(m["batches"]))
_add(
    "agg2_counts_per_site",
    """select site_id, coalesce(batches,0) batches, coalesce(files,0) files, coalesce(errors,0) errors from sites
       left join (select site_id, count(*) batches from batches group by 1) using (site_id)
       left join (select site_id, count(*) files from batches join uploaded_files using (batch_id) group by 1) using (site_id)
       left join (select site_id, count(*) errors from error_logs group by 1) using (site_id)""",
    lambda m: stats.counts_per_site(m["batches"], m["files"], m["errors"], m["sites"]),
)
_AGG3 = """select batch_id, coalesce(files,0) files, coalesce(errors,0) errors from batches
       left join (select batch_id, count(*) files from uploaded_files group by 1) using (batch_id)
       left join (select batch_id, count(*) errors from error_logs group by 1) using (batch_id)"""
_add("agg3_counts_per_batch", _AGG3, lambda m: stats.counts_per_batch(m["batches"], m["files"], m["errors"]))
_add("agg4_sites_per_account", "select account_id, count(*) sites, count(*) filter (is_active) active_sites from sites group by 1", lambda m: stats.sites_per_account(m["sites"]))
_add("agg5_active_batches", "select count(*) filter (status='IN_PROGRESS') active_batches from batches", lambda m: stats.active_batches(m["batches"]))
_add("sta1_account_statistics", _STA1 + "select * from sta1", _sta1)
_add(
    "sta2_global_statistics",
    """select (select count(*) from accounts) accounts, (select count(*) from accounts where is_active) active_accounts, (select count(*) from sites) sites,
       (select count(*) from sites where is_active) active_sites, (select count(*) from batches) batches, (select count(*) from batches where status='IN_PROGRESS') active_batches,
       (select count(*) from batches where status='COMPLETED') completed_batches, (select count(*) from batches where status='FAILED') failed_batches,
       (select count(*) from uploaded_files) files, (select cast(sum(file_size) as bigint) from uploaded_files) bytes, (select count(*) from error_logs) errors""",
    lambda m: stats.global_statistics(*(m[k] for k in _ALL)),
)
_add(
    "sta3_site_statistics",
    """select site_id, account_id, coalesce(batches,0) batches, coalesce(c,0) completed_batches, coalesce(fa,0) failed_batches, coalesce(h,false) has_active_batch,
       coalesce(files,0) files, cast(coalesce(bytes,0) as bigint) bytes, coalesce(errors,0) errors from sites
       left join (select site_id, count(*) batches, count(*) filter (status='COMPLETED') c, count(*) filter (status='FAILED') fa, bool_or(status='IN_PROGRESS') h from batches group by 1) using (site_id)
       left join (select site_id, count(*) files, sum(file_size) bytes from batches join uploaded_files using (batch_id) group by 1) using (site_id)
       left join (select site_id, count(*) errors from error_logs group by 1) using (site_id)""",
    lambda m: stats.site_statistics(m["sites"], m["batches"], m["files"], m["errors"]),
)
_add("sta4_batch_statistics", f"select b.batch_id, site_id, status, files, errors from batches b join ({_AGG3}) c on b.batch_id = c.batch_id", lambda m: stats.batch_statistics(m["batches"], m["files"], m["errors"]))
_add(
    "sta5_all_levels",
    """select account_id, site_id, grouping(account_id)*2 + grouping(site_id) as level, count(*) batches, count(*) filter (status='IN_PROGRESS') active_batches,
       count(*) filter (status='COMPLETED') completed_batches, count(*) filter (status='FAILED') failed_batches, cast(coalesce(sum(f),0) as bigint) files, cast(coalesce(sum(b),0) as bigint) bytes
       from batches left join (select batch_id, count(*) f, sum(file_size) b from uploaded_files group by 1) using (batch_id)
       group by grouping sets ((), (account_id), (account_id, site_id))""",
    lambda m: stats.all_levels(m["batches"], m["files"]),
)
_STA6 = """derived as (select batch_id, coalesce(fc,0) file_count, cast(coalesce(bc,0) as bigint) byte_count, coalesce(ae,false) or status='FAILED' has_errors from batches
       left join (select batch_id, count(*) fc, sum(file_size) bc from uploaded_files group by 1) using (batch_id)
       left join (select distinct batch_id, true ae from error_logs where batch_id is not null) using (batch_id))"""
_add("sta6_derived_counters", f", {_STA6} select * from derived", lambda m: stats.derived_counters(m["batches"], m["files"], m["errors"]))
_add(
    "sta7_counter_drift",
    f""", {_STA6}, known as (select batch_id, file_count, byte_count, has_errors derived_errors from derived union all
       select batch_id, count(*), cast(sum(file_size) as bigint), null from uploaded_files where batch_id not in (select batch_id from batches) group by 1),
       stored as (select batch_id, cast(uploaded_files_count as bigint) stored_files, total_size stored_bytes, has_errors stored_errors from batches)
       select *, coalesce(stored_files,0) - coalesce(file_count,0) files_delta, coalesce(stored_bytes,0) - coalesce(byte_count,0) bytes_delta from stored full join known using (batch_id)
       where stored_files is distinct from file_count or stored_bytes is distinct from byte_count or stored_errors is distinct from derived_errors""",
    lambda m: stats.counter_drift(m["batches"], m["files"], m["errors"]),
)
_add(
    "sta8_errors_by_type_and_month",
    "select type, cast(date_trunc('month', occurred_at) as timestamp) period, count(*) errors from error_logs group by 1, 2",
    lambda m: stats.errors_by_type(m["errors"], "month"),
)
_add(
    "sta9_outcomes",
    """select status, count(*) batches, avg(s) avg_seconds, quantile_cont(s, 0.5) p50_seconds, quantile_cont(s, 0.95) p95_seconds, count(*) / (select count(*) from batches) as share
       from (select status, cast(epoch_us(completed_at) - epoch_us(started_at) as double) / 1e6 s from batches) group by 1""",
    lambda m: stats.outcomes(m["batches"], exact=True),
)
_add(
    "sta9_success_share",
    "select count(*) filter (status<>'IN_PROGRESS') ended, count(*) filter (status='COMPLETED') completed_batches, count(*) filter (status='COMPLETED') / count(*) filter (status<>'IN_PROGRESS') success_share from batches",
    lambda m: stats.success_share(m["batches"]),
)
_add(
    "sta10_uploads_per_day",
    "select cast(date_trunc('day', uploaded_at) as timestamp) as day, count(*) files, cast(sum(file_size) as bigint) bytes from uploaded_files group by 1",
    lambda m: stats.uploads_per_day(m["files"]),
)
_add(
    "sta10_storage_per_account",
    "select account_id, cast(sum(file_size) as bigint) bytes from uploaded_files join batches using (batch_id) group by 1",
    lambda m: stats.storage_per_account(m["files"], m["batches"]),
)
_add("sta11_page_totals", "select count(*) total_elements, cast(ceil(count(*) / 20) as bigint) total_pages from batches", lambda m: stats.page_totals(m["batches"], 20))

# Pages
_add("pag1_account_page", "select * from accounts order by created_at desc, account_id desc limit 10 offset 10", lambda m: paging.page(m["accounts"], "account_id", 1, 10))
_add("pag2_batch_page", "select * from batches order by started_at desc, batch_id desc limit 20 offset 40", lambda m: paging.batch_page(m["batches"], 2))
_add("pag2_error_page", "select * from error_logs order by occurred_at desc, error_id desc limit 20", lambda m: paging.error_page(m["errors"]))
_add(
    "pag3_site_envelope",
    """select *, 3 page, 7 size, (select count(*) from sites) total_elements, cast(ceil((select count(*) from sites) / 7) as bigint) total_pages
       from (select * from sites order by "domain", site_id limit 7 offset 21)""",
    lambda m: paging.envelope(m["sites"], "site_id", 3, 7, "domain,asc"),
)
_add(
    "pag4_batches_after",
    "select * from batches where started_at < timestamp '2000-01-01' or (started_at = timestamp '2000-01-01' and batch_id < 50) order by started_at desc, batch_id desc limit 20",
    lambda m: paging.page_after(m["batches"], "batch_id", (datetime(2000, 1, 1), 50), 20, "started_at,desc"),
)
_add(
    "pag5_latest_batch_per_site",
    "select * from (select * from batches qualify row_number() over (partition by site_id order by started_at desc, batch_id desc) = 1)",
    lambda m: paging.latest_batches(m["batches"]),
)

# Scalars
_add(
    "sca1_normalised_names",
    """select site_id, "domain" norm, display_name as trimmed from sites""",
    lambda m: m["sites"].select("site_id", S.normalised(F.concat(F.lit(" \t\n"), F.upper("domain"), F.lit("\x01 "))).alias("norm"), S.trimmed(F.concat(F.lit("\r "), F.col("display_name"))).alias("trimmed")),
)
_add(
    "sca2_sca3_patterns",
    r"""select site_id, regexp_full_match(display_name||'@'||"domain", '[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as email_ok,
        regexp_full_match(replace("domain", '7', 'X'), '[a-z0-9.-]+') domain_ok from sites""",
    lambda m: m["sites"].select("site_id", S.is_email(F.concat_ws("@", "display_name", "domain")).alias("email_ok"), S.is_domain(F.replace("domain", F.lit("7"), F.lit("X"))).alias("domain_ok")),
)
_add(
    "sca4_sca5_digests",
    "select file_id, md5(file_id) m, sha256(file_id) s, true as same, true as hex from uploaded_files",
    lambda m: m["files"].select(
        "file_id", S.digest("file_id", "md5").alias("m"), S.digest("file_id").alias("s"), S.same_digest("checksum", F.upper("checksum")).alias("same"), S.is_hex("checksum").alias("hex")
    ),
)
_add(
    "sca6_sca7_sca8_texts",
    """select error_id, case when contains(message, ',') or contains(message, '"') or contains(message, chr(10)) then '"'||replace(message, '"', '""')||'"' else message end field,
       strftime(occurred_at, '%Y-%m-%d %H:%M:%S') plain, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S')||regexp_replace(strftime(occurred_at, '.%f'), '\\.?0+$', '') iso,
       case when error_id % 2 = 0 then metadata else '' end meta from error_logs""".replace("\\\\", "\\"),
    lambda m: m["errors"].select(
        "error_id", S.csv_field("message").alias("field"), S.plain_time("occurred_at").alias("plain"), S.iso_time("occurred_at").alias("iso"),
        S.metadata_text(F.when(F.col("error_id") % 2 == 0, F.col("metadata")).otherwise("{ }")).alias("meta"),
    ),
)
_add(
    "sca9_sca10_deadlines",
    """select batch_id, timestamp '2001-07-01' - interval 60 minute cut, cast(case when status <> 'IN_PROGRESS' then 0
       else greatest(0, floor((epoch_us(started_at) + 1440000::bigint * 60000000 - epoch_us(timestamp '2001-07-01')) / 60000000)) end as bigint) remaining from batches""",
    lambda m: m["batches"].select(
        "batch_id",
        S.cutoff(F.lit(AS_OF).cast("timestamp_ntz"), 60).alias("cut"),
        S.remaining_minutes(F.col("started_at"), F.col("status"), F.lit(AS_OF).cast("timestamp_ntz"), 1_440_000).alias("remaining"),
    ),
)
_add(
    "sca11_sca12_months",
    """select error_id, strftime(occurred_at, 'error_logs_%Y_%m') part, cast(date_trunc('month', occurred_at) as date) first, cast(date_trunc('month', occurred_at) + interval 1 month as date) past,
       cast(date_trunc('month', occurred_at) + interval 1 month as date) next, cast(date_trunc('month', occurred_at) - interval 24 month as date) cut from error_logs""",
    lambda m: m["errors"].select(
        "error_id", S.partition_name("occurred_at").alias("part"), S.month_start("occurred_at").alias("first"), S.month_end("occurred_at").alias("past"),
        S.next_month("occurred_at").alias("next"), S.retention_cutoff("occurred_at", 24).alias("cut"),
    ),
)
_add(
    "sca13_sca14_defaults",
    "select error_id, coalesce(cast(batch_id as varchar), '') batch, case when error_id % 2 = 0 then '10.0.0.'||(error_id % 200) else 'peer' end address from error_logs",
    lambda m: m["errors"].select(
        "error_id",
        S.or_default(F.col("batch_id").cast("string")).alias("batch"),
        S.client_address(F.when(F.col("error_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), (F.col("error_id") % 200).cast("string"), F.lit(" , proxy"))), F.lit("peer")).alias("address"),
    ),
)
