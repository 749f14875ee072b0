"""CSV exports of errors, byte for byte, and the landing layout."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.operators.filters import error_filter

#: Header and columns of the two dialects.
DIALECTS = {
    "admin": ("ID,Batch ID,Site ID,Type,Message,Metadata,Occurred At", ("error_id", "batch_id", "site_id", "type", "message", "metadata", "plain")),
    "service": ("id,batchId,siteId,type,message,occurredAt,metadata", ("error_id", "batch_id", "site_id", "type", "message", "iso", "metadata")),
}


def _field(name: str) -> Column:
    if name == "plain":
        return S.csv_field(S.plain_time("occurred_at"))
    if name == "iso":
        return S.csv_field(S.iso_time("occurred_at"))
    return S.csv_field(S.metadata_text(name) if name == "metadata" else name)


def csv_rows(errors: DataFrame, dialect: str) -> DataFrame:
    """SNK1 (``admin``), SNK2 (``service``): one text column ``value``; :func:`write_csv` puts the rows in order.

    A null batch is an empty field; fields are quoted for commas, quotes and
    line feeds only.
    """
    _, columns = DIALECTS[dialect]
    return errors.select(F.concat_ws(",", *map(_field, columns)).alias("value"))


def scoped(errors: DataFrame, batch=None, site=None) -> DataFrame:
    """SNK3: the errors of one batch or one site."""
    if batch is not None:
        errors = errors.filter(F.col("batch_id") == F.lit(batch))
    return error_filter(errors, site)


def write_csv(errors: DataFrame, path: str, dialect: str = "admin", single_file: bool = False) -> None:
    """SNK1-3: text parts in order, newest first, each with the header; an export without rows is a part with the header only.

    Parts are ranges of time, so no task sorts everything; ``single_file`` is
    for small exports: what is before the sort keeps its tasks, the sort has one.
    """
    header, columns = DIALECTS[dialect]
    order = [F.col("occurred_at").desc(), F.col("error_id").desc()]
    placed = errors.repartitionByRange(1, *order) if single_file else errors.repartitionByRange(*order)
    rows = placed.sortWithinPartitions(*order).select(F.concat_ws(",", *map(_field, columns)).alias("value"))
    _with_header(rows, header).write.text(path)
    spark = errors.sparkSession
    if spark.read.text(path).isEmpty():  # what was written is looked at, the input is not run again
        spark.range(1).select(F.lit(header).alias("value")).write.mode("overwrite").text(path)


def _with_header(rows: DataFrame, header: str) -> DataFrame:
    """The header before every part's first row."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return rows.select(F.when(first, F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))


#: SNK5: a folder with more rows is cut into objects of about so many.
OBJECT_ROWS = 1_000_000
#: SNK5: about so many folders are written by a task; what a folder costs is its object, however few its rows.
TASK_FOLDERS = 200


def write_landing(rows: DataFrame, path: str, fmt: str = "parquet", object_rows: int = OBJECT_ROWS, task_folders: int = TASK_FOLDERS) -> None:
    """SNK5: ``account_id/domain/d/t`` folders by the batch's start (``started_at``).

    A folder's rows are one object, or as many as hold ``object_rows`` each.
    Tasks are shared out by the number of folders, which are counted first. A
    domain's folders are one task's, so that the job's commit moves it as a
    whole; only a domain of more than ``task_folders`` is dealt to several. CSV
    for a local file system goes there from Python (see :func:`_write_local`).
    """
    keys, domain = ("account_id", "domain", "d", "t"), ("account_id", "domain")
    placed = rows.withColumns({"d": F.date_format("started_at", "yyyy-MM-dd"), "t": F.date_format("started_at", "HH-mm")})
    folders = placed.groupBy(*keys).agg(F.ceil(F.count("*") / object_rows).alias("__pieces"))
    counted = folders.groupBy(*domain).agg(F.ceil(F.count("*") / task_folders).alias("__parts"), F.sum("__pieces").alias("objects"), F.max("__pieces").alias("most"))
    objects, parts, most = counted.agg(*[F.coalesce(c, F.lit(0)) for c in (F.sum("objects"), F.max("__parts"), F.max("most"))]).first()
    if parts > 1:
        placed = _marked(placed, counted.filter("__parts > 1").select(*domain, "__parts"), domain)
        placed = placed.withColumn("__parts", F.pmod(F.xxhash64("d", "t"), "__parts"))
    if most > 1:
        placed = _marked(placed, folders.filter("__pieces > 1"), keys)
        placed = placed.withColumn("__pieces", F.pmod(F.monotonically_increasing_id(), "__pieces"))
    extra = [c for c in ("__parts", "__pieces") if c in placed.columns]
    spread = placed.repartition(max(1, -(-objects // task_folders)), *domain, *extra).drop(*extra)
    if fmt == "csv" and (local := _local_path(rows.sparkSession, path)):
        _write_local(spread, local, keys)
    else:
        spread.write.mode("append").partitionBy(*keys).format(fmt).save(path)


def _local_path(spark, path: str) -> str | None:
    """The path on a local (or mounted) file system, None where ``path`` is elsewhere."""
    if not re.match(r"\w+:", path):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + os.path.abspath(path)
    found = re.match(r"file:(?://)?(/.*)$", path)
    return found and found[1]


#: Characters that Spark writes as %XX in the names of partition folders.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _write_local(spread: DataFrame, path: str, keys: tuple) -> None:
    """The partitions of ``spread`` as CSV objects in Spark's layout of folders by ``keys``, lines as Spark's writer forms them.

    Hadoop's local file system without its native library starts a process for
    every folder and file that it makes, which took nearly all the time. An
    object is written beside its place under a hidden name and moved; a repeated
    task writes the same names again. ``_SUCCESS`` comes when all are there.
    """
    run_id = uuid.uuid4().hex
    line = F.to_csv(F.struct(*[c for c in spread.columns if c not in keys]))
    names = [F.nullif(F.col(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = spread.select(F.spark_partition_id().alias("task"), *names, line.alias("line"))
    ordered = rows.sortWithinPartitions(*[f"k{i}" for i in range(len(keys))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, hidden, final, n = None, None, "", "", 0

        def done():
            if out:
                out.close()
                os.replace(hidden, final)

        for batch in batches:
            values = [batch.column(f"k{i}").to_pylist() for i in range(len(keys))]
            for task, folder, text in zip(batch.column("task").to_pylist(), zip(*values, strict=True), batch.column("line").to_pylist(), strict=True):
                if folder != at:
                    done()
                    parts = [f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else _ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in zip(keys, folder, strict=True)]
                    place, name = os.path.join(path, *parts), f"part-{task:05d}-{run_id}.csv"
                    os.makedirs(place, exist_ok=True)
                    hidden, final, at, n = f"{place}/.{name}-{uuid.uuid4().hex}", f"{place}/{name}", folder, n + 1
                    out = open(hidden, "w", encoding="utf-8", newline="")  # noqa: SIM115
                out.write(text + "\n")
        done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["objects"])

    ordered.mapInArrow(run, "objects long").agg(F.sum("objects")).first()
    os.makedirs(path, exist_ok=True)
    open(f"{path}/_SUCCESS", "w").close()


def _marked(rows: DataFrame, few: DataFrame, keys: tuple) -> DataFrame:
    """``rows`` with the last column of ``few``, 1 where ``few`` has not the row's keys (null is a key like others)."""
    mark = few.columns[-1]
    there = few.select(*[F.col(k).alias(f"__{k}") for k in keys], mark)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(there, same, "left").drop(*there.columns[:-1]).fillna(1, [mark])
