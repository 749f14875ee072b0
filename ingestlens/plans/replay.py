"""Replay of the event feed as queries; their SQL folds each key's events one by one in a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.operators import lifecycle

_BATCH = "struct(site varchar, account varchar, bid varchar, started timestamp, names varchar[], bytes bigint, err boolean)[]"
_NEW = "struct_pack(site := b.site, account := b.account, bid := b.bid, started := b.started, names := {names}, bytes := {bytes}, err := {err})"
_OWNER = "coalesce((select cast(c_nationkey as varchar) from customer where c_custkey = user_id), 'site-'||user_id)"


def fold_sql(key: str = "site", limit: int | None = None, account: str = "cast(null as varchar)", until: str = "(select max(ts) from events)") -> str:
    """Common tables ``st`` (a row per event: open batches after it, what expired before it, what it ended or why not) and ``batches`` without end time given."""
    many = f"len(live) >= {limit}" if limit is not None else "false"
    return f"""with recursive feed as (
  select event_id, ts as "at", cast(user_id as varchar) site, {account} account, case event_type when 'signup' then 'b'||event_id end bid,
         case event_type when 'signup' then 'START' when 'purchase' then 'COMPLETE' when 'error' then 'ERROR' else 'UPLOAD' end "action",
         case when event_type in ('view', 'click') then 'f'||(event_id % 3) end fname, case when event_type in ('view', 'click') then cast(trunc("value" * 1024) as bigint) end fsize
  from events where ts <= {until}),
e as (select *, {key} k, row_number() over (partition by {key} order by "at", event_id) n from feed),
st as (
  select distinct k, cast(0 as bigint) n, cast([] as {_BATCH}) open, cast([] as {_BATCH}) late, cast([] as {_BATCH}) done, cast(null as varchar) reason,
         cast(null as bigint) event_id, cast(null as timestamp) "at", cast(null as varchar) site, cast(null as varchar) account, cast(null as varchar) bid, cast(null as varchar) "action" from e
  union all
  select k, n,
         case when reason is not null then live
              when "action" = 'START' then list_append(live, struct_pack(site := site, account := account, bid := bid, started := "at", names := cast([] as varchar[]), bytes := cast(0 as bigint), err := false))
              when "action" = 'COMPLETE' then list_filter(live, lambda b: b.site <> site)
              when "action" = 'ERROR' then list_transform(live, lambda b: case when b.site = site then {_NEW.format(names="b.names", bytes="b.bytes", err="true")} else b end)
              else list_transform(live, lambda b: case when b.site = site then {_NEW.format(names="list_append(b.names, fname)", bytes="b.bytes + fsize", err="b.err")} else b end) end,
         late, case when "action" = 'COMPLETE' and reason is null then mine else [] end, reason, event_id, "at", site, account, bid, "action"
  from (select *, case when "action" = 'ERROR' then null
                  when "action" = 'START' then case when len(mine) > 0 then 'ACTIVE_EXISTS' when {many} then 'LIMIT' end
                  when len(mine) = 0 then 'NOT_OPEN'
                  when "action" = 'UPLOAD' then case when coalesce(fsize, 0) <= 0 then 'EMPTY_FILE' when fsize > 134217728 then 'TOO_LARGE' when list_contains(mine[1].names, fname) then 'DUPLICATE_NAME' end end reason
        from (select *, list_filter(live, lambda b: b.site = site) mine
              from (select e.*, list_filter(st.open, lambda b: e."at" <= b.started + interval 1 hour) live, list_filter(st.open, lambda b: e."at" > b.started + interval 1 hour) late
                    from st join e on e.k = st.k and e.n = st.n + 1)))),
last_open as (select unnest(open) b from st where n = (select max(x.n) from st x where x.k = st.k)),
ended as (
  select b, b.started + interval 1 hour ended_at, 'NOT_COMPLETED' status from (select unnest(late) b from st)
  union all select done[1], "at", 'COMPLETED' from st where len(done) > 0)
"""


def _named(rows: str) -> str:
    return f"select b.bid batch_id, b.site site_id, b.account account_id, status, b.started started_at, ended_at completed_at, len(b.names) files, b.bytes bytes, b.err has_errors from ({rows})"


def _events(spark: SparkSession, sf_dir: str, owned: bool = False) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return lifecycle.feed(read("events"), read("customer") if owned else None)


def _plain_times(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at", "t") if c in rows.columns})


_REJECTED = 'select site site_id, bid batch_id, event_id, "at" t, "action", reason from st where reason is not null'
QUERIES = {
    "lif2_replayed_batches": lambda spark, sf_dir: _plain_times(lifecycle.replay(_events(spark, sf_dir), key="site_id")[0]),
    "lif2_rejected_events": lambda spark, sf_dir: _plain_times(lifecycle.replay(_events(spark, sf_dir), key="site_id")[1]),
    "lif3_limited_replay": lambda spark, sf_dir: _plain_times(lifecycle.replay(_events(spark, sf_dir, True), key="account_id", limit=2)[1]),
    "lif3_limited_batches": lambda spark, sf_dir: _plain_times(lifecycle.replay(_events(spark, sf_dir, True), key="account_id", limit=2)[0]),
}
_ALL = "select * from ended union all select b, null, 'IN_PROGRESS' from last_open"
ORACLE_SQL = {
    "lif2_replayed_batches": fold_sql() + _named(_ALL),
    "lif2_rejected_events": fold_sql() + _REJECTED,
    "lif3_limited_replay": fold_sql("account", 2, _OWNER) + _REJECTED,
    "lif3_limited_batches": fold_sql("account", 2, _OWNER) + _named(_ALL),
}

#: The last watermark of a stream over all events, in whole milliseconds.
PASSED = "(select date_trunc('milliseconds', max(ts)) from events)"
#: LIF6's rows: starts, ends, rejections up to the last watermark; what is over by then is closed.
STREAM_ROWS = f""", rows_ as (
  select site key, site site_id, account account_id, bid batch_id, 'STARTED' event, "at", 0 files, 0 bytes, false has_errors, cast(null as varchar) reason from st where "action" = 'START' and reason is null
  union all select site, site, null, bid, 'REJECTED', "at", null, null, null, reason from st where reason is not null
  union all select b.site, b.site, b.account, b.bid, status, ended_at, len(b.names), b.bytes, b.err, null
    from (select * from ended union all select b, b.started + interval 1 hour, 'NOT_COMPLETED' from last_open where b.started + interval 1 hour < {PASSED}))
"""
