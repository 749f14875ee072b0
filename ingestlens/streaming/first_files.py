"""STR2 with state that ends with the batch: the first file of each name, as VAL4 finds it."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ingestlens.schemas import TIMEOUT_MINUTES
from ingestlens.streaming.lifecycle import STATE_STORE
from ingestlens.streaming.lots import LOTS, Names, Waiting, as_tuples, lot_of, reached, wake

_TEXT, _LONG = T.StringType(), T.LongType()
_struct = lambda **fields: T.StructType([T.StructField(n, t) for n, t in fields.items()])
ROW = _struct(file_id=_TEXT, at=_LONG, batch_id=_TEXT, name=_TEXT, ends=T.BooleanType())
PIECE_KEY = _struct(first_at=_LONG, file_id=_TEXT, nth=_LONG)
PIECE_OF_ROWS = _struct(rows=T.ArrayType(ROW))
BATCH = _struct(batch_id=_TEXT)
BEGAN = _struct(at=_LONG, files=_LONG, saved=_LONG)
NAME = _struct(batch_id=_TEXT, name=_TEXT)
SEEN = _struct(at=_LONG)
PART = _struct(batch_id=_TEXT, nth=_LONG)
PART_NAMES = _struct(names=T.ArrayType(_TEXT))
OUT = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("original_file_name", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("uploaded_at", T.TimestampType()),
    ]
)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


class FirstFiles(StatefulProcessor):
    """State of a lot of batches: files that wait for the watermark, when its open batches began and their names; nothing of a batch once it is over.

    A call handles all that is due of the lot in memory; a batch that begins and
    ends within it is never written.
    """

    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle) -> None:
        self.handle = handle
        self.began = handle.getMapState("began", BATCH, BEGAN)
        self.names = handle.getMapState("names", NAME, SEEN)
        self.parts = handle.getMapState("parts", PART, PART_NAMES)
        self.waiting = Waiting(handle.getMapState("waiting", PIECE_KEY, PIECE_OF_ROWS))

    def handleInputRows(self, key, rows, timerValues):
        new = as_tuples(rows, ROW.names)
        self.waiting.keep(new)
        due = min(reached(r[1]) for r in new)
        times = list(self.handle.listTimers())
        if not times or due < min(times):
            wake(self.handle, [due])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        before = {k[0]: tuple(v) for k, v in self.began.iterator()} if self.began.exists() else {}
        open_ = {b: (at, Names(self.names, self.parts, (b,), saved, n)) for b, (at, n, saved) in before.items()}
        due, later = self.waiting.due(now)
        for file_id, at, batch, name, ends in due:
            if batch in open_ and (ends or at > open_[batch][0] + self.lifetime):
                open_.pop(batch)[1].forget()
            if ends:
                continue
            if batch not in open_:
                open_[batch] = (at, Names(self.names, self.parts, (batch,)))
            names = open_[batch][1]
            if name is not None:
                if name in names:
                    continue
                names[name] = at
            yield T.Row(batch_id=batch, original_file_name=name, file_id=file_id, uploaded_at=_EPOCH + timedelta(microseconds=at))
        for batch in [b for b, (at, _) in open_.items() if now > at + self.lifetime]:
            open_.pop(batch)[1].forget()
        for batch, (at, names) in open_.items():
            row = (at, len(names), names.save())
            if before.get(batch) != row:
                self.began.updateValue((batch,), row)
        for batch in before.keys() - open_.keys():
            self.began.removeKey((batch,))
        wake(self.handle, [*map(reached, later), *((at + self.lifetime) // 1000 + 1 for at, _ in open_.values())])

    def close(self) -> None:
        pass


def first_files(files: DataFrame, minutes: int = TIMEOUT_MINUTES, delay: str = "0 seconds", ends: str | None = None, lots: int = LOTS) -> DataFrame:
    """STR2: ``batch_id, original_file_name, file_id, uploaded_at`` of the first file of each name in a batch.

    ``files`` (``uploaded_at`` as TIMESTAMP) may come in any order within
    ``delay``: a file waits until the watermark has passed its time, and of one
    name the earliest stays, then the one with the smallest id, as in VAL4. A
    batch lives ``minutes`` from its first file on, or until a row whose column
    ``ends`` is true; then its names go, so state is that of the batches that
    are open. A later file begins the batch anew. Rows without a batch are none
    of a batch and are left out; a file without a name is no other's repeat.
    Batches are dealt to ``lots``; a task holds a lot's share of a micro-batch at
    a time.
    """
    kept = files.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if kept != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE} for this stream")
    rows = files.withWatermark("uploaded_at", delay).filter("batch_id is not null").select(
        lot_of(F.col("batch_id").cast("string"), lots).alias("lot"), F.col("batch_id").cast("string").alias("batch_id"), "uploaded_at", F.unix_micros("uploaded_at").alias("at"), F.col("file_id").cast("string").alias("file_id"),
        F.col("original_file_name").alias("name"), (F.coalesce(F.col(ends), F.lit(False)) if ends else F.lit(False)).alias("ends"),
    )
    return rows.groupBy("lot").transformWithState(statefulProcessor=FirstFiles(minutes * 60_000_000), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
