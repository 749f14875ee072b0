"""LIF6: the lifecycle with timeout as a stream, by the same fold as the replay.

Rows wait in state until the watermark has passed their time, and are then
applied in order of time and id, so that rows which come out of order, within
one micro-batch or over several, give what the replay gives.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ingestlens.operators.fold import Rules, close_expired, step
from ingestlens.schemas import TIMEOUT_MINUTES
from ingestlens.streaming.lots import LOTS, Names, Waiting, as_tuples, lot_of, reached, wake

_TEXT, _LONG = T.StringType(), T.LongType()
_struct = lambda **fields: T.StructType([T.StructField(n, t) for n, t in fields.items()])
SITE = _struct(key=_TEXT, site_id=_TEXT)
OPEN = _struct(batch_id=_TEXT, account_id=_TEXT, at=_LONG, files=_LONG, bytes=_LONG, has_errors=T.BooleanType(), saved=_LONG)
NAME = _struct(key=_TEXT, site_id=_TEXT, file_name=_TEXT)
SIZE = _struct(file_size=_LONG)
PART = _struct(key=_TEXT, site_id=_TEXT, nth=_LONG)
PART_NAMES = _struct(names=T.ArrayType(_TEXT))
PIECE_KEY = _struct(first_at=_LONG, event_id=_LONG, nth=_LONG)
OUT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("files", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("has_errors", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("time", T.TimestampType()),
    ]
)
WAITING = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_size", T.LongType()),
    ]
)
PIECE_OF_ROWS = _struct(rows=T.ArrayType(WAITING))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class Lifecycle(StatefulProcessor):
    """State of a lot of keys: their open batches, these batches' file names, the rows that wait for the watermark; one timer, for the earliest thing to do.

    A row's key is its field ``key``. A call applies all that is due of the lot
    in memory, and reads and writes the state by pieces of many rows; what
    begins and ends within a call is never written. With ``uploads``, accepted
    files are rows too (``event`` UPLOADED, their size in ``bytes``).
    """

    def __init__(self, rules: Rules, uploads: bool = False, key: str = "site_id"):
        self.rules, self.uploads, self.key = rules, uploads, WAITING.names.index(key)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", SITE, OPEN)
        self.names = handle.getMapState("names", NAME, SIZE)
        self.parts = handle.getMapState("parts", PART, PART_NAMES)
        self.waiting = Waiting(handle.getMapState("waiting", PIECE_KEY, PIECE_OF_ROWS))

    def _load(self) -> tuple[dict, dict]:
        """Key to site to open batch, as the fold wants them, and the stored rows."""
        open_: dict = {}
        stored = {tuple(k): tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        for (key, site), (b, a, at, n, size, bad, saved) in stored.items():
            names = Names(self.names, self.parts, (key, site), saved, n)
            open_.setdefault(key, {})[site] = {"site_id": site, "batch_id": b, "account_id": a, "at": at, "names": names, "bytes": size, "has_errors": bad}
        return open_, stored

    def _save(self, before: dict, open_: dict) -> None:
        left = set()
        for key, sites in open_.items():
            for site, b in sites.items():
                left.add((key, site))
                row = (b["batch_id"], b["account_id"], b["at"], len(b["names"]), b["bytes"], b["has_errors"], b["names"].save())
                if before.get((key, site)) != row:
                    self.open.updateValue((key, site), row)
        for gone in before.keys() - left:
            self.open.removeKey(gone)

    def _row(self, key, event: str, at: int, site, batch, account=None, files=None, size=None, bad=None, reason=None):
        return T.Row(key=key, site_id=site, account_id=account, batch_id=batch, event=event, at=at, files=files, bytes=size, has_errors=bad, reason=reason, time=_EPOCH + timedelta(microseconds=at))

    def _rows(self, key, found: list[dict]):
        for r in found:
            if r["kind"] == "batch":
                yield self._row(key, r["status"], r["completed_at"], r["site_id"], r["batch_id"], r["account_id"], r["files"], r["bytes"], r["has_errors"])
            else:
                yield self._row(key, "REJECTED", r["t"], r["site_id"], r["batch_id"], reason=r["reason"])

    def handleInputRows(self, key, rows, timerValues):
        new = as_tuples(rows, WAITING.names)
        self.waiting.keep(new)
        times = list(self.handle.listTimers())
        first = min(reached(r[1]) for r in new)
        if not times or first < min(times):
            wake(self.handle, [first])
        return iter(())

    def _applied(self, name, open_: dict, e: dict):
        """Rows that event ``e`` gives, of its key's open batches; the names of batches that end are forgotten."""
        site, had = e["site_id"], dict(open_)
        size = had[site]["bytes"] if site in had else None
        found = step(open_, e, self.rules)
        yield from self._rows(name, found)
        # What a site's names were is forgotten before it can start again.
        for s, b in had.items():
            if open_.get(s) is not b:
                b["names"].forget()
        b = open_.get(site)
        if b and had.get(site) is not b:
            b["names"] = Names(self.names, self.parts, (name, site))
            yield self._row(name, "STARTED", b["at"], b["site_id"], b["batch_id"], b["account_id"], 0, 0, False)
        elif self.uploads and b and b["bytes"] > size:
            yield self._row(name, "UPLOADED", e["at"], b["site_id"], b["batch_id"], b["account_id"], 1, b["bytes"] - size)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Timers and the watermark count milliseconds, the fold microseconds.
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        open_, before = self._load()
        due, later = self.waiting.due(now)
        for r in due:
            name = r[self.key]
            yield from self._applied(name, open_.setdefault(name, {}), dict(zip(WAITING.names, r, strict=True)))
        for name, sites in open_.items():
            had = dict(sites)
            yield from self._rows(name, close_expired(sites, now, self.rules))
            for s in had.keys() - sites.keys():
                had[s]["names"].forget()
        self._save(before, open_)
        # Watermarks count milliseconds. A batch exactly at its deadline is still open, hence one more.
        ends = [self.rules.closes_at(b["at"]) // 1000 + 1 for sites in open_.values() for b in sites.values()]
        wake(self.handle, [*map(reached, later), *ends])

    def close(self) -> None:
        pass


def lifecycle_stream(
    events: DataFrame,
    key: str = "site_id",
    minutes: int = TIMEOUT_MINUTES,
    limit: int | None = None,
    expire_at: str = "deadline",
    delay: str = "0 seconds",
    uploads: bool = False,
    chained: bool = False,
    lots: int = LOTS,
) -> DataFrame:
    """Rows STARTED, the four ends, and REJECTED for a stream of events (see ``schemas.EVENTS``) in any order within ``delay``.

    ``delay`` is the watermark's; rows later than it are dropped by Spark. The
    result does not depend on how the events fall into micro-batches: a row
    waits until the watermark passes its time, and then a key's rows are applied
    in order of time and id; what expired before a row is closed before it. When
    a stream ends, rows less than ``delay`` older than its last one still wait.
    A limit per account needs the account as key, whose open batches are then
    one state. Rows within the last millisecond wait as well. ``uploads`` adds a
    row UPLOADED for every accepted file. With ``chained``, ``at`` is the event
    time of what follows, with the same watermark, so windows over it can be
    counted in the same stream. ``key`` is a column of the events; keys are
    dealt to ``lots``, each of which one call handles for a micro-batch, so a
    task holds a lot's share of a micro-batch at a time. The session must keep state in ``STATE_STORE``.
    """
    kept = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if kept != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE} for this stream")
    rows = events.withWatermark("t", delay).select(
        lot_of(F.col(key), lots).alias("lot"), "t", "event_id", F.unix_micros("t").alias("at"), "account_id", "site_id", "batch_id", "action", "file_name", "file_size"
    )
    out = rows.groupBy("lot").transformWithState(
        statefulProcessor=Lifecycle(Rules(minutes * 60_000_000, limit, expire_at), uploads, key), outputStructType=OUT, outputMode="Append", timeMode="EventTime", eventTimeColumnName="time" if chained else "",
    )
    columns = [f.name for f in OUT if f.name not in ("at", "time")]
    return out.select(*columns[:5], F.col("time").alias("at"), *columns[5:])
