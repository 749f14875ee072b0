"""Queries over validation, audits and lifecycle operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ingestlens.operators import lifecycle, quality
from ingestlens.plans.views import SQL, model
from ingestlens.sources import export, partitions

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, sql: str | None, f) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(model(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = SQL + sql


_joined = lambda c: F.array_join(c, ",").alias(c)

_add(
    "val1_rejected_sites",
    """select site_id, concat_ws(',', case when not regexp_full_match(d, '[a-z0-9.-]+') then 'DOMAIN_FORMAT' end, case when trim(n) = '' then 'DISPLAY_NAME_BLANK' end,
       case when length(n) = 1 and trim(n) <> '' then 'DISPLAY_NAME_LENGTH' end) reasons
       from (select site_id, case when site_id % 3 = 0 then upper("domain") else "domain" end d, case site_id % 4 when 0 then ' ' when 1 then 'x' else display_name end n from sites)
       where site_id % 3 = 0 or site_id % 4 < 2""",
    lambda m: quality.validate(
        m["sites"].withColumn("domain", F.when(F.col("site_id") % 3 == 0, F.upper("domain")).otherwise(F.col("domain"))).withColumn(
            "display_name", F.when(F.col("site_id") % 4 == 0, " ").when(F.col("site_id") % 4 == 1, "x").otherwise(F.col("display_name"))
        ),
        "sites",
    )[1].select("site_id", _joined("reasons")),
)
_add(
    "val1_rejected_files",
    "select file_id, concat_ws(',', case when file_size % 5 = 0 then 'SIZE_NOT_POSITIVE' end, case when starts_with(checksum, 'f') then 'CHECKSUM_FORMAT' end) reasons from uploaded_files where file_size % 5 = 0 or starts_with(checksum, 'f')",
    lambda m: quality.validate(
        m["files"].withColumn("checksum", F.regexp_replace("checksum", "^f", "g")).withColumn("file_size", F.when(F.col("file_size") % 5 == 0, 0).otherwise(F.col("file_size"))), "uploaded_files"
    )[1].select("file_id", _joined("reasons")),
)
_add("val2_duplicate_names", "select batch_id, original_file_name, count(*) n from uploaded_files group by 1, 2 having count(*) > 1", lambda m: quality.duplicates(m["files"], "uploaded_files"))
_add(
    "val2_duplicate_emails",
    "select lower(name)||'@x.org' email, 2::bigint n from accounts where account_id % 2 = 0",
    lambda m: quality.duplicates(
        m["accounts"].select(F.concat("name", F.lit("@x.org")).alias("email")).union(m["accounts"].filter("account_id % 2 = 0").select(F.concat(F.lower("name"), F.lit("@X.org")))), "accounts"
    ),
)
_add("val3_several_open", "select site_id, count(*) n from batches where status='IN_PROGRESS' group by 1 having count(*) > 1", lambda m: quality.several_open(m["batches"]))
_VAL4 = "select *, row_number() over (partition by batch_id, original_file_name order by uploaded_at, file_id) nth from uploaded_files"
_add("val4_first_uploads", f"select * exclude (nth) from ({_VAL4}) where nth = 1", lambda m: quality.first_uploads(m["files"])[0])
_add("val4_later_uploads", f"select * exclude (nth) from ({_VAL4}) where nth > 1", lambda m: quality.first_uploads(m["files"])[1])
_add(
    "val5_admission",
    """, j as (select f.*, case when file_size % 11 = 0 then 'EMPTY_FILE' when b.status is null then 'BATCH_NOT_FOUND' when b.status <> 'IN_PROGRESS' then 'BATCH_NOT_OPEN' end r
       from uploaded_files f left join batches b using (batch_id))
       select file_id, case when r is null and row_number() over (partition by batch_id, original_file_name, r is null order by uploaded_at, file_id) > 1 then 'DUPLICATE_NAME' else r end reason from j""",
    lambda m: quality.admission(m["files"].withColumn("file_size", F.when(F.col("file_size") % 11 == 0, 0).otherwise(F.col("file_size"))), m["batches"]).select("file_id", "reason"),
)
_add("val6_over_quota", "select batch_id, count(*) files from uploaded_files group by 1 having count(*) > 7", lambda m: quality.over_quota(m["files"], 7))
_add(
    "val7_metadata_reasons",
    """select error_id, case error_id % 6 when 0 then 'METADATA_INVALID' when 1 then 'METADATA_EMPTY_KEY' when 2 then 'METADATA_KEY_LENGTH' when 3 then 'METADATA_SIZE' when 4 then 'METADATA_ENTRIES' end reason from error_logs""",
    lambda m: m["errors"].withColumn(
        "metadata",
        F.when(F.col("error_id") % 6 == 0, "{broken")
        .when(F.col("error_id") % 6 == 1, '{"": 1}')
        .when(F.col("error_id") % 6 == 2, F.concat(F.lit('{"'), F.repeat(F.lit("k"), 101), F.lit('": 1}')))
        .when(F.col("error_id") % 6 == 3, F.concat(F.lit('{"k": "'), F.repeat(F.lit("é"), 5120), F.lit('"}')))
        .when(F.col("error_id") % 6 == 4, F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('": 1'))), ","), F.lit("}")))
        .otherwise(F.col("metadata")),
    ).select("error_id", quality.metadata_reason().alias("reason")),
)
_add(
    "val8_references",
    """select 'site.account' reference, (select count(*) from sites where account_id not in (select account_id from accounts)) violations union all
       select 'batch.site', (select count(*) from batches where site_id not in (select site_id from sites)) union all
       select 'batch.account', (select count(*) from batches where account_id not in (select account_id from accounts)) union all
       select 'file.batch', (select count(*) from uploaded_files where batch_id not in (select batch_id from batches where batch_id % 10 <> 3)) union all
       select 'error.site', (select count(*) from error_logs where site_id not in (select site_id from sites)) union all
       select 'error.batch', (select count(*) from error_logs where batch_id not in (select batch_id from batches where batch_id % 10 <> 3))""",
    lambda m: quality.referential_report(m["accounts"], m["sites"], m["batches"].filter("batch_id % 10 <> 3"), m["files"], m["errors"]),
)
_add(
    "val9_storage_difference",
    """, f as (select file_id s3_key, file_size, checksum from uploaded_files where file_size % 13 <> 0), s as (select distinct on (file_id) file_id s3_key, file_size + (case when file_size % 17 = 0 then 1 else 0 end) stored_size,
       case when file_size % 19 = 0 then 'ab' else upper(checksum) end stored_checksum from uploaded_files where file_size % 7 <> 0)
       select s3_key, 'ORPHAN_OBJECT' kind from s where s3_key not in (select s3_key from f) union all select s3_key, 'MISSING_OBJECT' from f where s3_key not in (select s3_key from s)
       union all select s3_key, 'SIZE_MISMATCH' from f join s using (s3_key) where file_size <> stored_size union all select s3_key, 'DIGEST_MISMATCH' from f join s using (s3_key) where lower(checksum) <> lower(stored_checksum)""",
    lambda m: quality.storage_difference(
        m["files"].filter("file_size % 13 <> 0").select(F.col("file_id").alias("s3_key"), "file_size", "checksum"),
        m["files"].filter("file_size % 7 <> 0").select(
            F.col("file_id").alias("s3_key"), (F.col("file_size") + F.when(F.col("file_size") % 17 == 0, 1).otherwise(0)).alias("stored_size"),
            F.when(F.col("file_size") % 19 == 0, "ab").otherwise(F.upper("checksum")).alias("stored_checksum"),
        ).dropDuplicates(["s3_key"]),
    ),
)
_add(
    "val10_tenancy_audit",
    """select 'FOREIGN_ERROR' kind, cast(error_id as varchar) id from error_logs e join batches b using (batch_id) where e.site_id <> b.site_id union all
       select 'ACTIVE_SITE_INACTIVE_ACCOUNT', cast(site_id as varchar) from sites s join accounts a using (account_id) where s.is_active and not a.is_active union all
       select 'BATCH_OF_INELIGIBLE_SITE', cast(batch_id as varchar) from batches b join sites s using (site_id) join accounts a on s.account_id = a.account_id where not (s.is_active and a.is_active)""",
    lambda m: quality.tenancy_audit(m["accounts"], m["sites"], m["batches"], m["errors"]),
)
_add(
    "val11_content_duplicates",
    "select checksum, count(*) files, count(distinct batch_id) batches, count(distinct site_id) sites from uploaded_files join batches using (batch_id) group by 1 having count(*) > 1",
    lambda m: quality.content_duplicates(m["files"], m["batches"]),
)
_add(
    "val12_incoherent",
    """select batch_id, concat_ws(',', case when batch_id % 5 = 0 and status <> 'IN_PROGRESS' then 'ENDED_WITHOUT_TIME' end, case when status = 'FAILED' and batch_id % 4 = 0 then 'FAILED_WITHOUT_ERRORS' end) reasons
       from batches where (batch_id % 5 = 0 and status <> 'IN_PROGRESS') or (status = 'FAILED' and batch_id % 4 = 0)""",
    lambda m: quality.incoherent(
        m["batches"].withColumn("completed_at", F.when(F.col("batch_id") % 5 != 0, F.col("completed_at"))).withColumn("has_errors", F.col("has_errors") & (F.col("batch_id") % 4 != 0))
    ).select("batch_id", _joined("reasons")),
)

# Lifecycle over tables
_SWEEP = datetime(2001, 7, 1, 0, 5)
_add(
    "lif1_transitions",
    """select a.status "from", b.status "to", a.status = 'IN_PROGRESS' and b.status <> 'IN_PROGRESS' allowed from (select distinct status from batches) a, (select distinct status from batches) b""",
    lambda m: m["batches"].select(F.col("status").alias("from")).distinct().crossJoin(m["batches"].select(F.col("status").alias("to")).distinct()).withColumn("allowed", lifecycle.may_become("from", "to")),
)
_add(
    "lif4_timeout_sweep",
    """select batch_id, case when e then 'NOT_COMPLETED' else status end status, case when e then timestamp '2001-07-01 00:05:00' else completed_at end completed_at
       from (select *, status = 'IN_PROGRESS' and started_at < timestamp '2001-07-01 00:05:00' - interval 60 minute e from batches)""",
    lambda m: lifecycle.sweep(m["batches"], _SWEEP)[0].select("batch_id", "status", "completed_at"),
)
_add(
    "lif4_expired_events",
    "select batch_id, site_id, account_id, timestamp '2001-07-01 00:05:00' occurred_at from batches where status = 'IN_PROGRESS' and started_at < timestamp '2001-07-01 00:05:00' - interval 60 minute",
    lambda m: lifecycle.sweep(m["batches"], _SWEEP)[1],
)
_COMMANDS = lambda m: m["batches"].filter("batch_id % 6 = 0").select(
    "batch_id",
    F.when(F.col("batch_id") % 12 == 0, F.col("site_id")).otherwise(F.col("site_id") + F.col("batch_id") % 4).alias("site_id"),
    F.element_at(F.array(*map(F.lit, ("COMPLETE", "FAIL", "CANCEL"))), (F.col("batch_id") % 18 / 6 + 1).cast("int")).alias("action"),
    F.lit(datetime(2002, 1, 1)).cast("timestamp_ntz").alias("at"),
)
_CMD = """, cmd as (select batch_id, case when batch_id % 12 = 0 then site_id else site_id + batch_id % 4 end site_id, ['COMPLETE','FAIL','CANCEL'][cast(batch_id % 18 / 6 + 1 as integer)] as action from batches where batch_id % 6 = 0),
  ok as (select c.batch_id, c.action from cmd c join batches b on c.batch_id = b.batch_id where c.site_id = b.site_id and b.status = 'IN_PROGRESS') """
_add(
    "lif5_commands_applied",
    _CMD + """select b.batch_id, coalesce(case action when 'COMPLETE' then 'COMPLETED' when 'FAIL' then 'FAILED' when 'CANCEL' then 'CANCELLED' end, status) status,
       coalesce(action = 'FAIL', false) or has_errors has_errors, case when action is not null then timestamp '2002-01-01' else completed_at end completed_at from batches b left join ok using (batch_id)""",
    lambda m: lifecycle.apply_commands(m["batches"], _COMMANDS(m))[0].select("batch_id", "status", "has_errors", "completed_at"),
)
_add(
    "lif5_commands_rejected",
    _CMD + "select c.batch_id, c.action, case when c.site_id <> b.site_id then 'FOREIGN_SITE' else 'NOT_OPEN' end reason from cmd c join batches b on c.batch_id = b.batch_id where c.site_id <> b.site_id or b.status <> 'IN_PROGRESS'",
    lambda m: lifecycle.apply_commands(m["batches"], _COMMANDS(m))[1].select("batch_id", "action", "reason"),
)
_add(
    "lif7_error_flags",
    "select batch_id, has_errors or batch_id in (select batch_id from error_logs where batch_id is not null) has_errors from batches",
    lambda m: lifecycle.flag_errors(m["batches"], m["errors"]).select("batch_id", "has_errors"),
)
_add(
    "lif8_deactivated_sites",
    """select site_id, is_active and account_id not in (2, 3, 7) is_active, case when is_active and account_id in (2, 3) then timestamp '2002-01-01' else created_at end updated_at from sites""",
    lambda m: lifecycle.deactivate_accounts(
        m["accounts"].withColumn("updated_at", F.col("created_at")), m["sites"].withColumn("updated_at", F.col("created_at")), m["accounts"].filter("account_id in (2, 3, 7)").select("account_id"), datetime(2002, 1, 1)
    )[1].select("site_id", F.when(F.col("account_id") == 7, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"), "updated_at"),
)
_add(
    "lif9_changed_sites",
    "select site_id, case when site_id % 3 = 0 then 'Renamed '||site_id else display_name end display_name, case when site_id % 5 = 0 then false else is_active end is_active from sites",
    lambda m: lifecycle.change(
        m["sites"].withColumn("updated_at", F.col("created_at")),
        m["sites"].filter("site_id % 3 = 0 or site_id % 5 = 0").select(
            "site_id", F.when(F.col("site_id") % 3 == 0, F.concat(F.lit(" Renamed "), F.col("site_id").cast("string"))).alias("display_name"), F.when(F.col("site_id") % 5 == 0, False).alias("is_active")
        ),
        "sites",
        datetime(2002, 1, 1),
    ).select("site_id", "display_name", "is_active"),
)
_add(
    "lif10_deleted_batches",
    """select 'batches' "table", count(*) n from batches where batch_id % 9 <> 0 union all select 'files', count(*) from uploaded_files where not (batch_id % 9 = 0 and batch_id in (select batch_id from batches))
       union all select 'errors', count(*) from error_logs where batch_id is null or not (batch_id % 9 = 0 and batch_id in (select batch_id from batches))""",
    lambda m: _counts(lifecycle.delete_batches(m["batches"], m["files"], m["errors"], m["batches"].filter("batch_id % 9 = 0").select("batch_id"))),
)


def _counts(tables):
    names = ("batches", "files", "errors")
    parts = [t.agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n, t in zip(names, tables, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Exports and partitions
_CSV = """case when contains(x, ',') or contains(x, '"') or contains(x, chr(10)) then '"'||replace(x, '"', '""')||'"' else x end"""
_esc = lambda c: f"(select {_CSV} from (select coalesce(cast({c} as varchar), '') x))"
_iso = "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S')||regexp_replace(strftime(occurred_at, '.%f'), '\\.?0+$', '')"
_add(
    "snk1_admin_csv",
    "select concat_ws(',', cast(error_id as varchar), coalesce(cast(batch_id as varchar),''), cast(site_id as varchar), type, " + _CSV.replace("x", "message") + ", " + _CSV.replace("x", "metadata") + ", strftime(occurred_at, '%Y-%m-%d %H:%M:%S')) \"value\" from error_logs",
    lambda m: export.csv_rows(m["errors"], "admin"),
)
_add(
    "snk2_service_csv",
    "select concat_ws(',', cast(error_id as varchar), coalesce(cast(batch_id as varchar),''), cast(site_id as varchar), type, " + _CSV.replace("x", "message") + ", " + _iso + ", " + _CSV.replace("x", "metadata") + ") \"value\" from error_logs",
    lambda m: export.csv_rows(m["errors"], "service"),
)
_add(
    "snk3_site_csv",
    "select concat_ws(',', cast(error_id as varchar), coalesce(cast(batch_id as varchar),''), cast(site_id as varchar), type, " + _CSV.replace("x", "message") + ", " + _iso + ", " + _CSV.replace("x", "metadata") + ") \"value\" from error_logs where site_id = 8",
    lambda m: export.csv_rows(export.scoped(m["errors"], site=8), "service"),
)
_add(
    "par1_month_coverage",
    """select strftime(d, '%Y_%m') ym, strftime(d, '%Y_%m') in (select strftime(occurred_at, '%Y_%m') from error_logs) as present
       from (select unnest(generate_series(timestamp '2021-01-01', timestamp '2024-03-01', interval 1 month)) d)""",
    lambda m: partitions.coverage(m["errors"], datetime(2021, 1, 1), datetime(2024, 2, 10)),
)
_add(
    "par2_retained_errors",
    "select error_id, occurred_at from error_logs where strftime(occurred_at, '%Y_%m') > '2022_02'",
    lambda m: partitions.retained(m["errors"], datetime(2024, 2, 10), 24).select("error_id", "occurred_at"),
)
