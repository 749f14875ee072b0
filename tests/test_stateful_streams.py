"""State of the streams: the same results however rows fall into micro-batches, bounded, and right when a micro-batch is repeated."""

import json
import time
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import Row
from pyspark.sql import functions as F

from ingestlens.operators import filters, lifecycle, quality
from ingestlens.operators.fold import Rules
from ingestlens.plans import streams
from ingestlens.sources import auth_log, partitions
from ingestlens.streaming import first_files, metrics
from ingestlens.streaming.lifecycle import WAITING, Lifecycle, lifecycle_stream

MICRO = 1_000_000


def as_stream(spark, rows, place, cuts, per_trigger=1):
    """Collected rows as a stream of ``cuts`` files in order."""
    got, size = rows.collect(), -(-rows.count() // cuts)
    for i in range(cuts):
        spark.createDataFrame(got[i * size : (i + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(str(place))
        time.sleep(0.02)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(str(place))


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_outcome_metrics(spark, tmp_path, cuts):
    """All measures equal the replay's, up to the last window that the watermark closed, with rows out of order."""
    base = lifecycle.feed(spark.read.parquet(f"{SMALL}/events.parquet"))
    nth = F.col("event_id") % 11
    ends = F.when(nth == 3, "COMPLETE").when(nth == 5, "FAIL").when(nth == 7, "CANCEL")
    # More ends than the given events have, and START more often, so that batches come to each of them.
    events = base.withColumn("action", F.when(nth > 8, "START").when(F.col("action") == "ERROR", "ERROR").otherwise(F.coalesce(ends, "action")))
    events = events.withColumns({"site_id": F.pmod(F.hash("event_id"), F.lit(3)).cast("string"), "batch_id": F.lit(None).cast("string")})
    mixed = events.orderBy(F.unix_micros("t") + F.pmod(F.hash("event_id"), F.lit(3000 * MICRO)), "event_id")
    errors = mixed.filter("action = 'ERROR'").select(F.col("t").alias("occurred_at"), F.concat(F.lit("T"), (F.col("event_id") % 3).cast("string")).alias("type"))
    with streams._state_store(spark):
        out = metrics.outcome_metrics(as_stream(spark, mixed, tmp_path / "events", cuts), as_stream(spark, errors, tmp_path / "errors", cuts), "1 day", "3000 seconds")
        got = {(r["window_start"].replace(tzinfo=UTC), r["measure"], r["kind"]): (r["n"], r["bytes"]) for r in streams.finished(out).collect()}
    last = lambda rows, c: rows.agg(F.unix_micros(F.max(c))).first()[0] // 1000 * 1000 - 3000 * MICRO
    passed = min(last(events, "t"), last(errors, "occurred_at"))
    batches, rejected = lifecycle.replay(events.filter(F.unix_micros("t") <= passed), as_of=datetime.fromtimestamp(passed / MICRO, UTC))
    refused = {r["event_id"] for r in rejected.collect()}
    want: Counter = Counter()
    size: Counter = Counter()
    day = lambda t: t.replace(tzinfo=UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    names = {"COMPLETED": "completed", "FAILED": "failed", "CANCELLED": "cancelled", "NOT_COMPLETED": "expired"}
    for b in batches.collect():
        want[day(b["started_at"]), "started", None] += 1
        if b["completed_at"]:
            want[day(b["completed_at"]), names[b["status"]], None] += 1
    for e in events.collect():
        if e["action"] == "UPLOAD" and e["event_id"] not in refused:
            want[day(e["t"]), "files", None] += 1
            size[day(e["t"]), "files", None] += e["file_size"]
        if e["action"] == "ERROR":
            want[day(e["t"]), "errors", f"T{e['event_id'] % 3}"] += 1
    end = datetime.fromtimestamp(passed / MICRO, UTC)
    assert got == {k: (n, size.get(k)) for k, n in want.items() if k[0] + timedelta(days=1) <= end}
    assert {k[1] for k in got} == {"started", "completed", "failed", "cancelled", "expired", "files", "errors"}


def test_active_counts_after_every_batch(spark, tmp_path):
    events = lifecycle.feed(spark.read.parquet(f"{SMALL}/events.parquet"), spark.read.parquet(f"{SMALL}/customer.parquet"))
    ordered = events.orderBy("t", "event_id")
    with streams._state_store(spark):
        flow = lifecycle_stream(as_stream(spark, ordered, tmp_path / "in", 4))
        metrics.active_counts(flow, str(tmp_path / "counts"), str(tmp_path / "checkpoint"), None).start().awaitTermination()
    rows, size = ordered.collect(), -(-ordered.count() // 4)
    for version in range(1, 5):
        seen = rows[: version * size]
        end = max(r["t"] for r in seen).replace(tzinfo=UTC)
        end = end.replace(microsecond=end.microsecond // 1000 * 1000)
        upto = spark.createDataFrame([r for r in seen if r["t"].replace(tzinfo=UTC) <= end], events.schema)
        want = Counter()
        for b in lifecycle.replay(upto, as_of=end)[0].collect():
            want[b["account_id"]] += b["completed_at"] is None
        got = {r["account_id"]: r["active_batches"] for r in spark.read.parquet(f"{tmp_path}/counts/place={version}").collect()}
        assert got == dict(want)
    assert {r["account_id"]: r["active_batches"] for r in metrics.current_counts(spark, str(tmp_path / "counts")).collect()} == got


def test_repeated_batch_changes_no_count(spark, tmp_path):
    path = str(tmp_path / "counts")
    rows = lambda *r: spark.createDataFrame(r, "account_id string, event string")
    first, second = rows(("a", "STARTED"), ("a", "STARTED"), ("b", "STARTED")), rows(("a", "COMPLETED"), (None, "REJECTED"), ("c", "STARTED"), ("a", "UPLOADED"))
    for number, changes in ((0, first), (0, first), (1, second), (1, second), (2, rows(("b", "NOT_COMPLETED")))):
        metrics.add_changes(changes, number, path)
    assert {r["account_id"]: r["active_batches"] for r in metrics.current_counts(spark, path).collect()} == {"a": 1, "b": 0, "c": 1}


class Held:
    """A map or value state in memory that counts what is read and written."""

    def __init__(self, counts):
        self.kept, self.counts = {}, counts

    def _count(self, n=1):
        self.counts["ops"] += n

    def exists(self):
        return bool(self.kept)

    def updateValue(self, key, value):
        self._count(len(value[0]) if isinstance(value[0], list) else 1)
        self.kept[key] = value

    def getValue(self, key):
        value = self.kept[key]
        self._count(len(value[0]) if isinstance(value[0], list) else 1)
        return value

    def containsKey(self, key):
        self._count()
        return key in self.kept

    def removeKey(self, key):
        self._count()
        self.kept.pop(key, None)

    def keys(self):
        return list(self.kept)

    def iterator(self):
        self._count(len(self.kept))
        return list(self.kept.items())


class Handle:
    def __init__(self):
        self.counts, self.timers = Counter(), set()

    def getMapState(self, *a):
        return Held(self.counts)

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_state_work_of_a_busy_key_is_linear():
    """One site's rows over many micro-batches, all within the delay: the rows read and written grow as the rows do."""

    def work(batches):
        p, handle, out = Lifecycle(Rules(10**15)), Handle(), []
        p.init(handle)
        for b in range(batches):
            at = lambda i: (b * 100 + i) * MICRO  # noqa: B023, E731
            rows = [Row(**dict(zip(WAITING.names, (b * 100 + i, at(i), "a", "s", None, "UPLOAD" if b + i else "START", f"f{b}-{i}", 5), strict=True))) for i in range(100)]
            list(p.handleInputRows(("s",), iter(rows), None))
            now = at(0) // 1000 - 50 * 100 * 1000  # 50 micro-batches late
            if handle.timers and min(handle.timers) <= now:
                times = type("T", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})()
                info = type("I", (), {"getExpiryTimeInMs": lambda self: 0})()
                out += p.handleExpiredTimer(("s",), times, info)
        return handle.counts["ops"]

    assert work(400) < 2.6 * work(200)


def test_first_files_state_ends_with_the_batch(spark, tmp_path):
    """VAL4's rows from any order within the delay, and only what is open in state."""
    rows = []
    for b in range(200):
        start = datetime(2024, 1, 1) + timedelta(minutes=b * 30)
        rows += [(f"{b}-{k:02d}", b, None if k == 7 else f"n{k % 4}", start + timedelta(minutes=(k * 7) % 50)) for k in range(12)]
    files = spark.createDataFrame(rows, "file_id string, batch_id long, original_file_name string, uploaded_at timestamp")
    mixed = files.orderBy(F.unix_micros("uploaded_at") + F.pmod(F.hash("file_id"), F.lit(600 * MICRO)), "file_id")
    with streams._state_store(spark):
        flow = first_files.first_files(as_stream(spark, mixed, tmp_path / "in", 5), delay="600 seconds")
        query = flow.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    end = max(r[3] for r in rows) - timedelta(seconds=600)
    got = {(r["batch_id"], r["original_file_name"], r["file_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    first = quality.first_uploads(files.filter(F.col("uploaded_at") <= F.lit(end)))[0]
    assert got == {(str(r["batch_id"]), r["original_file_name"], r["file_id"]) for r in first.collect()}
    # At its end four batches are open or wait; without an end all 200 would be kept.
    assert state and state[-1] < 200


def test_first_files_end_with_a_row(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("1", "b", "n", t(0), False), ("2", "b", "n", t(1), False), ("3", "b", None, t(2), True), ("4", "b", "n", t(3), False), ("5", None, "n", t(3), False), ("9", "z", "last", t(500), False)]
    files = spark.createDataFrame(rows, "file_id string, batch_id string, original_file_name string, uploaded_at timestamp, over boolean")
    with streams._state_store(spark):
        out = streams.finished(first_files.first_files(as_stream(spark, files, tmp_path / "in", 1), ends="over"))
    assert {r["file_id"] for r in out.collect()} == {"1", "4", "9"}


def test_log_lines(spark, tmp_path):
    said = "auth_failure: Authentication failed for GET /a from 1.2.3.4"
    lines = [
        {"@timestamp": "2024-01-01T00:00:01.5Z", "message": said, "ip": "9.9.9.9, 1.1.1.1", "endpoint": "/b", "method": "POST", "status": 401},
        {"@timestamp": "2024-01-01T00:00:02+01:00", "message": said, "mdc": {"ip": "8.8.8.8", "endpoint": "/c", "method": "PUT", "status": "403"}, "new": {"x": [1]}},
        {"@timestamp": "2024-01-01T00:00:03Z", "message": said, "level": {"odd": 1}},
        {"@timestamp": "2024-01-01T00:00:04Z", "message": "served"},
        {"@timestamp": "soon", "message": said},
        {"message": "no time"},
    ]
    text = [*map(json.dumps, lines), '{"@timestamp": "2024', "plain words", ""]
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(str(tmp_path / "log"))
    log = auth_log.read_log(spark, str(tmp_path / "log"), streaming=False)
    got = [(r["address"], r["endpoint"], r["method"], r["status"]) for r in auth_log.failures(log).orderBy("t").collect()]
    assert sorted(got, key=str) == sorted([("9.9.9.9", "/b", "POST", "401"), ("8.8.8.8", "/c", "PUT", "403"), ("1.2.3.4", "/a", "GET", None)], key=str)
    bad = Counter((r["reason"], r["line"]) for r in auth_log.rejected_lines(log).collect())
    assert bad == {("BROKEN_JSON", '{"@timestamp": "2024'): 1, ("BROKEN_JSON", "plain words"): 1, ("NO_TIME", said): 1, ("NO_TIME", "no time"): 1}


ERRORS = "error_id string, site_id string, batch_id string, type string, message string, metadata string, occurred_at timestamp_ntz"


def test_append_can_be_repeated(spark, tmp_path):
    path, bad = str(tmp_path / "errors"), str(tmp_path / "bad")
    rows = [(f"e{i}", "s", None, "T" if i % 4 else " ", "m", None, datetime(2024, 1 + i % 3, 3, i % 24)) for i in range(60)]
    errors = spark.createDataFrame(rows, ERRORS)
    partitions.append_errors(errors.filter("error_id < 'e3'"), path, bad)
    for _ in range(2):
        partitions.append_errors(errors.union(errors.limit(5)), path, bad)
    stored = spark.read.parquet(path)
    assert sorted(r["error_id"] for r in stored.collect()) == sorted(f"e{i}" for i in range(60) if i % 4)
    assert spark.read.parquet(bad).count() == 15
    # One id at two times is two rows, as the key has both.
    partitions.append_errors(spark.createDataFrame([("e1", "s", None, "T", "m", None, datetime(2024, 9, 9))], ERRORS), path, bad)
    assert spark.read.parquet(path).count() == 46
    before = sorted(map(str, spark.read.parquet(path).collect()))
    assert partitions.compact(spark, path, files=1) and not partitions.compact(spark, path, files=1)
    assert sorted(map(str, spark.read.parquet(path).collect())) == before


def test_busy_months_are_cut_and_small_ones_are_one_file(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("error_id"), F.lit("busy").alias("site_id"), F.lit(None).cast("string").alias("batch_id"), F.lit("T").alias("type"),
        F.sha2(F.col("id").cast("string"), 512).alias("message"), F.lit(None).cast("string").alias("metadata"),
        F.when(F.col("id") % 100 < 97, F.lit("2024-01-05")).otherwise(F.concat(F.lit("2024-0"), (F.col("id") % 3 + 2).cast("string"), F.lit("-05"))).cast("timestamp_ntz").alias("occurred_at"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        partitions.append_errors(rows, str(tmp_path / "errors"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = Counter(p.parent.name for p in (tmp_path / "errors").rglob("*.parquet"))
    assert files.pop("ym=2024_01") > 3 and set(files.values()) == {1}


def test_dropped_months_leave_the_others_alone(spark):
    rows = [(f"e{i}", "s", None, "T", "m", None, datetime(2024, 1 + i % 12, 3)) for i in range(48)]
    partitions.create_table(spark.createDataFrame(rows, ERRORS), "errors_to_drop")
    try:
        listing = lambda: {p: (p.stat().st_mtime_ns, p.stat().st_ino) for p in place.rglob("*.parquet")}
        from pathlib import Path

        place = Path(spark.sql("describe table extended errors_to_drop").filter("col_name = 'Location'").first()["data_type"].removeprefix("file:"))
        before = listing()
        assert partitions.drop_months(spark, "errors_to_drop", datetime(2025, 6, 1), 12) == [f"2024_{m:02d}" for m in range(1, 7)]
        assert partitions.drop_months(spark, "errors_to_drop", datetime(2025, 6, 1), 12) == []
        assert listing() == {p: v for p, v in before.items() if p.parent.name > "ym=2024_06"}
        assert spark.table("errors_to_drop").count() == 24
    finally:
        spark.sql("drop table errors_to_drop")


def test_shredded_metadata_is_read_by_field(spark, tmp_path):
    rows = [(f"e{i}", "s", None, "T", "m", '{"k":%d,"other":"long text"}' % (i % 5) if i % 7 else None, datetime(2024, 1, 3)) for i in range(100)]
    errors = spark.createDataFrame(rows, ERRORS)
    partitions.append_errors(errors, str(tmp_path / "errors"), shredded=True)
    found = filters.metadata_is(spark.read.parquet(str(tmp_path / "errors")), "$.k", 3, "int", "metadata_v").select("error_id")
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "metadata_v:struct<0:int>" in scan
    assert {r[0] for r in found.collect()} == {r[0] for r in filters.metadata_is(errors, "$.k", 3, "int").collect()}
