"""Lots of keys: calls of the state do not grow with the keys, and rows sent twice all wait."""

from conftest import SMALL
from pyspark.sql import Row

from ingestlens.operators import lifecycle
from ingestlens.operators.fold import Rules
from ingestlens.plans import streams
from ingestlens.streaming import first_files
from ingestlens.streaming.lifecycle import WAITING, Lifecycle

MICRO = 1_000_000


class Map:
    """A map state in memory; ``calls`` counts what goes to the state server."""

    def __init__(self, handle):
        self.kept, self.handle = {}, handle

    def __getattr__(self, name):
        def call(*a):
            self.handle.calls += 1
            match name:
                case "exists":
                    return bool(self.kept)
                case "containsKey":
                    return a[0] in self.kept
                case "updateValue":
                    self.kept[a[0]] = a[1]
                case "getValue":
                    return self.kept[a[0]]
                case "removeKey":
                    self.kept.pop(a[0], None)
                case "keys":
                    return list(self.kept)
                case "iterator":
                    return list(self.kept.items())

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers, self.maps = 0, set(), {}

    def getMapState(self, name, *a):
        self.maps[name] = Map(self)
        return self.maps[name]

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def run(processor, batches):
    """The rows that come out of micro-batches ``(rows, watermark in seconds)``, and the handle."""
    handle, out = Handle(), []
    processor.init(handle)
    for rows, seconds in batches:
        if rows:
            list(processor.handleInputRows(("0",), iter(rows), None))
        if handle.timers and min(handle.timers) <= seconds * 1000:
            times = type("T", (), {"getCurrentWatermarkInMs": lambda self, at=seconds * 1000: at})()
            out += processor.handleExpiredTimer(("0",), times, type("I", (), {"getExpiryTimeInMs": lambda self: 0})())
    return out, handle


def event(i, seconds, site, action, name=None):
    return Row(**dict(zip(WAITING.names, (i, seconds * MICRO, "a", site, None, action, name, 5 if name else None), strict=True)))


def test_state_calls_of_many_sites():
    n = 2000
    rows = [event(3 * i + k, i + k, f"s{i}", a, f) for i in range(n) for k, (a, f) in enumerate((("START", None), ("UPLOAD", "f"), ("COMPLETE", None)))]
    out, handle = run(Lifecycle(Rules()), [(rows, n + 10)])
    assert sorted(r["event"] for r in out) == ["COMPLETED"] * n + ["STARTED"] * n
    assert handle.calls < len(rows) / 5 and not any(m.kept for m in handle.maps.values())


def test_state_calls_of_many_batches():
    row = lambda i, k: Row(file_id=f"{i}-{k}", at=(i + k) * MICRO, batch_id=f"b{i}", name="n", ends=False)
    rows = [row(i, k) for i in range(2000) for k in range(3)]
    out, handle = run(first_files.FirstFiles(10 * MICRO), [(rows, 3000)])
    assert sorted(r["file_id"] for r in out) == sorted(f"{i}-0" for i in range(2000))
    assert handle.calls < len(rows) / 5 and not any(m.kept for m in handle.maps.values())


def test_open_batches_over_calls_and_rows_sent_twice():
    """Names of earlier calls are known, what ends is forgotten, a row sent in two micro-batches is applied twice."""
    start = [event(1, 1, "s", "START"), event(2, 1, "t", "START"), event(3, 2, "s", "UPLOAD", "x")]
    again = [event(4, 20, "s", "UPLOAD", "x"), event(5, 20, "s", "UPLOAD", "y")]
    out, handle = run(Lifecycle(Rules()), [(start, 10), (again, 15), (again, 30), ([event(6, 40, "s", "COMPLETE"), event(7, 41, "s", "START"), event(8, 42, "s", "UPLOAD", "x")], 50)])
    got = [(r["event"], r["site_id"], r["files"], r["reason"]) for r in out]
    twice = [("REJECTED", "s", None, "DUPLICATE_NAME")] * 3
    assert got == [("STARTED", "s", 0, None), ("STARTED", "t", 0, None), *twice, ("COMPLETED", "s", 2, None), ("STARTED", "s", 0, None)]
    assert set(handle.maps["names"].kept) == {("s", "s", "x")} and set(handle.maps["open"].kept) == {("s", "s"), ("t", "t")}


def test_slices_of_several_files_are_one_micro_batch_each(spark, tmp_path):
    events = lifecycle.feed(spark.read.parquet(f"{SMALL}/events.parquet"))
    seen = []
    flow = streams.in_slices(spark, events, 4, file_rows=40)
    query = flow.writeStream.foreachBatch(lambda rows, n: seen.append((len(rows.inputFiles()), [r["t"] for r in rows.collect()])))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and len({files for files, _ in seen}) == 1
    assert all(max(a) < min(b) for (_, a), (_, b) in zip(seen, seen[1:], strict=False))
    assert sum(len(t) for _, t in seen) == events.count()
