"""Batch lifecycle: transitions, sweeps, commands and cascades over tables, and replay of event tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.operators.filters import expired
from ingestlens.operators.fold import Rules, finish, step
from ingestlens.operators.quality import validate
from ingestlens.schemas import CANCELLED, COMPLETED, FAILED, IN_PROGRESS, NOT_COMPLETED, TERMINAL, TIMEOUT_MINUTES


def may_become(old: str, new: str) -> Column:
    """LIF1: only from open to one of the four ends; unknown values may not."""
    return F.coalesce((F.col(old) == IN_PROGRESS) & F.col(new).isin(*TERMINAL), F.lit(False))


def sweep(batches: DataFrame, as_of: datetime, minutes: int = TIMEOUT_MINUTES) -> tuple[DataFrame, DataFrame]:
    """LIF4: the table with expired batches closed at ``as_of``, and an event row for each; sweeping again changes nothing."""
    now = F.lit(as_of).cast("timestamp_ntz")
    late = (F.col("status") == IN_PROGRESS) & (F.col("started_at") < S.cutoff(now, minutes))
    swept = batches.withColumns(
        {"completed_at": F.when(late, now).otherwise(F.col("completed_at")), "status": F.when(late, F.lit(NOT_COMPLETED)).otherwise(F.col("status"))}
    )
    return swept, expired(batches, as_of, minutes).select("batch_id", "site_id", "account_id", now.alias("occurred_at"))


_ENDS = {"COMPLETE": COMPLETED, "FAIL": FAILED, "CANCEL": CANCELLED}


def apply_commands(batches: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LIF5: ``commands`` (batch_id, site_id, action, at) applied; second, those rejected with their reason.

    Reasons in order: NOT_FOUND, FOREIGN_SITE, NOT_OPEN, UNKNOWN_ACTION. Of
    several commands on a batch the earliest acceptable one ends it, the others
    are NOT_OPEN.
    """
    known = batches.select("batch_id", F.col("site_id").alias("owner"), F.col("status").alias("_status"))
    reason = (
        F.when(F.col("_status").isNull(), F.lit("NOT_FOUND"))
        .when(~F.col("owner").eqNullSafe(F.col("site_id")), F.lit("FOREIGN_SITE"))
        .when(F.col("_status") != IN_PROGRESS, F.lit("NOT_OPEN"))
        .when(~F.col("action").isin(*_ENDS), F.lit("UNKNOWN_ACTION"))
    )
    judged = commands.join(known, "batch_id", "left").withColumn("reason", reason)
    chosen = judged.filter("reason is null").groupBy("batch_id").agg(F.min(F.struct("at", "action")).alias("_c"))
    repeated = judged.join(chosen, "batch_id", "left").withColumn(
        "reason", F.when(F.col("reason").isNull() & ~F.struct("at", "action").eqNullSafe(F.col("_c")), F.lit("NOT_OPEN")).otherwise(F.col("reason"))
    )
    ends = F.create_map(*[F.lit(x) for pair in _ENDS.items() for x in pair])
    action = F.col("_c.action")
    done = batches.join(chosen, "batch_id", "left").withColumns(
        {
            "status": F.coalesce(ends[action], F.col("status")),
            "has_errors": F.col("has_errors") | F.coalesce(action == "FAIL", F.lit(False)),
            "completed_at": F.coalesce(F.col("_c.at"), F.col("completed_at")),
        }
    )
    return done.select(*batches.columns), repeated.filter("reason is not null").select(*commands.columns, "reason")


def flag_errors(batches: DataFrame, errors: DataFrame) -> DataFrame:
    """LIF7: any error with a batch marks it for good; standalone errors mark nothing."""
    hit = errors.filter("batch_id is not null").select("batch_id").distinct().withColumn("_hit", F.lit(True))
    return batches.join(hit, "batch_id", "left").withColumn("has_errors", F.col("has_errors") | F.coalesce("_hit", F.lit(False))).select(*batches.columns)


def _switched_off(df: DataFrame, ids: DataFrame, key: str, at: datetime) -> DataFrame:
    off = ids.select(key).distinct().withColumn("_off", F.lit(True))
    joined = df.join(off, key, "left").withColumn("_off", F.coalesce("_off", F.lit(False)) & F.col("is_active"))
    return joined.withColumns(
        {"is_active": F.col("is_active") & ~F.col("_off"), "updated_at": F.when(F.col("_off"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("updated_at"))}
    ).select(*df.columns)


def deactivate_accounts(accounts: DataFrame, sites: DataFrame, ids: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """LIF8: the accounts of ``ids`` and, for those that were active, their active sites go inactive; running batches go on.

    Accounts that were inactive already change nothing. Activating an account
    (:func:`change`) does not cascade.
    """
    going = ids.select("account_id").distinct().join(accounts.filter("is_active").select("account_id"), "account_id", "left_semi")
    return _switched_off(accounts, going, "account_id", at), _switched_off(sites, going, "account_id", at)


def change(df: DataFrame, changes: DataFrame, table: str, at: datetime) -> DataFrame:
    """LIF9: ``changes`` (key, and new values or null) made to ``accounts`` or ``sites``; names are trimmed.

    A change that leaves a row invalid is not made. ``updated_at`` moves only
    where a value does.
    """
    key = {"accounts": "account_id", "sites": "site_id"}[table]
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[(S.trimmed(c) if c in ("name", "display_name") else F.col(c)).alias(f"_{c}") for c in columns])
    joined = df.join(new, key, "left")
    proposed = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    valid, _ = validate(proposed, table)
    good = valid.join(new, key, "left_semi").select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    final = df.join(good, key, "left")
    moved = F.lit(False)
    for c in columns:
        moved = moved | (F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)))
    values = {c: F.coalesce(f"_{c}", c) for c in columns} | {"updated_at": F.when(moved, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("updated_at"))}
    return final.withColumns(values).select(*df.columns)


def delete_batches(batches: DataFrame, files: DataFrame, errors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """LIF10: the three tables without the batches of ``ids`` and what hangs on them; stored objects stay."""
    gone = ids.select("batch_id").join(batches.select("batch_id"), "batch_id", "left_semi").distinct()
    return tuple(t.join(gone, "batch_id", "left_anti").select(*t.columns) for t in (batches, files, errors))


def feed(events: DataFrame, customer: DataFrame | None = None) -> DataFrame:
    """The events table as an event feed: sign-ups start, views and clicks upload, purchases complete."""
    kinds = {"signup": "START", "view": "UPLOAD", "click": "UPLOAD", "purchase": "COMPLETE", "error": "ERROR"}
    action = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    rows = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("t"),
        F.col("user_id").cast("string").alias("site_id"),
        F.when(action == "START", F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("batch_id"),
        action.alias("action"),
        F.when(action == "UPLOAD", F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"))).alias("file_name"),
        F.when(action == "UPLOAD", (F.col("value") * 1024).cast("long")).alias("file_size"),
    )
    if customer is None:
        return rows.withColumn("account_id", F.lit(None).cast("string"))
    owner = customer.select(F.col("c_custkey").cast("string").alias("site_id"), F.col("c_nationkey").cast("string").alias("account_id"))
    return rows.join(owner, "site_id", "left").withColumn("account_id", F.coalesce("account_id", F.concat(F.lit("site-"), "site_id")))


_BATCH = "batch_id string, site_id string, account_id string, status string, started_at timestamp, completed_at timestamp, files long, bytes long, has_errors boolean"
_REJECT = "event_id long, t timestamp, action string, reason string"


def _folded(events: DataFrame, key: str, rules: Rules, as_of: datetime | None) -> DataFrame:
    """The fold over every key's events in order of (time, id); one key's state at a time, never all its events."""
    names = ["kind", *(f.split()[0] for f in f"{_BATCH}, {_REJECT}".split(", "))]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
    types = [pa.string(), *(kinds[f.split()[1]] for f in f"{_BATCH}, {_REJECT}".split(", "))]
    end = None if as_of is None else round((as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)).timestamp() * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = object(), {}, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, types, strict=True)], names)

        for batch in batches:
            for e in batch.to_pylist():
                if e["key"] != now:
                    out += finish(open_, rules, end)
                    now, open_ = e["key"], {}
                out += step(open_, e, rules)
            if out:
                yield batch_of(out)
                out = []
        out += finish(open_, rules, end)
        if out:
            yield batch_of(out)

    rows = events.select(F.col(key).alias("key"), "event_id", F.unix_micros("t").alias("at"), "account_id", "site_id", "batch_id", "action", "file_name", "file_size")
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInArrow(run, f"kind string, {_BATCH}, {_REJECT}")


def replay(
    events: DataFrame,
    key: str = "site_id",
    minutes: int = TIMEOUT_MINUTES,
    limit: int | None = None,
    expire_at: str = "deadline",
    expire_on_start: bool = False,
    as_of: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """LIF2, LIF3: batches that ``events`` (see ``schemas.EVENTS``) lead to, and rejected events with their reason.

    ``key`` is ``account_id`` where ``limit`` (open batches of an account) holds,
    else ``site_id``. ``expire_at='deadline'`` closes a silent batch at its
    deadline, ``'tick'`` at the next five-minute sweep after it; with
    ``expire_on_start`` a start closes an expired batch before the sweep.
    Batches open at the end stay so, unless ``as_of`` (UTC) is past their deadline.
    """
    if limit is not None and key != "account_id":
        raise ValueError("a limit per account needs the account as key")
    folded = _folded(events, key, Rules(minutes * 60_000_000, limit, expire_at, expire_on_start), as_of)
    names = lambda fields: [f.split()[0] for f in fields.split(", ")]
    return (
        folded.filter("kind = 'batch'").select(*names(_BATCH)),
        folded.filter("kind = 'rejected'").select("site_id", "batch_id", *names(_REJECT)),
    )
