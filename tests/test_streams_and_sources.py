"""Streams equal the replay however they are cut; files written are read back, pruned and reconciled."""

import gzip
import hashlib
import time
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ingestlens.operators import lifecycle, quality
from ingestlens.plans import streams
from ingestlens.sources import landing, partitions, tables
from ingestlens.streaming.lifecycle import lifecycle_stream
from ingestlens.streaming.metrics import ingest_errors


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_lifecycle_stream_equals_replay(spark, tmp_path, cuts):
    """Every row of the stream, with events out of order within the delay, over one and several micro-batches."""
    events = lifecycle.feed(spark.read.parquet(f"{SMALL}/events.parquet"))
    rows = events.orderBy(F.unix_micros("t") + F.pmod(F.hash("event_id"), F.lit(7_000_000_000)), "event_id").collect()  # up to 7,000 s late
    size = -(-len(rows) // cuts)
    for i in range(cuts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], events.schema).coalesce(1).write.parquet(f"{tmp_path}/{i:02d}")
        time.sleep(0.02)  # files are taken in order of their time
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    with streams._state_store(spark):
        out = streams.finished(lifecycle_stream(source, delay="7000 seconds")).collect()
    got = sorted((r["event"], r["site_id"], r["batch_id"] or "", r["at"], r["files"], r["bytes"], r["reason"]) for r in out if r["event"] != "STARTED")
    end = events.agg(F.unix_micros(F.max("t"))).first()[0] // 1000 * 1000 - 7_000_000_000  # the last watermark
    batches, rejected = lifecycle.replay(events.filter(F.unix_micros("t") <= end), as_of=datetime.fromtimestamp(end / 1e6, UTC))
    want = [(r["status"], r["site_id"], r["batch_id"], r["completed_at"], r["files"], r["bytes"], None) for r in batches.collect() if r["completed_at"]]
    want += [("REJECTED", r["site_id"], r["batch_id"] or "", r["t"], None, None, r["reason"]) for r in rejected.collect()]
    assert got == sorted(want) and sum(r["event"] == "STARTED" for r in out) == batches.count()


def test_lifecycle_stream_names_the_setting_it_needs(spark):
    with pytest.raises(ValueError, match="providerClass"):
        lifecycle_stream(lifecycle.feed(streams.events_stream(spark, SMALL)))


def test_error_partitions(spark, tmp_path):
    rows = [(f"e{i}", "s1", None, "T", "m", '{"k":1}' if i % 3 else "{bad", datetime(2024, 1 + i % 12, 3)) for i in range(60)]
    errors = spark.createDataFrame(rows, "error_id string, site_id string, batch_id string, type string, message string, metadata string, occurred_at timestamp_ntz")
    path, bad = str(tmp_path / "errors"), str(tmp_path / "rejected")
    partitions.append_errors(errors, path, bad)
    assert spark.read.parquet(bad).count() == 20
    some = tables.load_errors(spark, path, datetime(2024, 2, 1), datetime(2024, 4, 1))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert {r["ym"] for r in some.select("ym").distinct().collect()} <= {"2024_02", "2024_03"}
    partitions.drop_expired(spark.read.parquet(path), datetime(2025, 6, 1), 12, str(tmp_path / "kept"))
    assert min(r["ym"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) > "2024_06"


def test_error_ingest_stream(spark, tmp_path):
    rows = [("e1", "s1", None, "T", "m", None, datetime(2024, 1, 3)), ("e2", "s1", None, " ", "m", None, datetime(2024, 1, 4))]
    errors = spark.createDataFrame(rows, "error_id string, site_id string, batch_id string, type string, message string, metadata string, occurred_at timestamp_ntz")
    errors.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(errors.schema).parquet(str(tmp_path / "in"))
    ingest_errors(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).start().awaitTermination()
    assert [r["error_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["e1"]
    assert [r["reasons"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [["TYPE_BLANK"]]


def test_landing_zone(spark, tmp_path):
    keys = ["a1/x.org/2025-01-15/12-00/one.csv.gz", "a1/x.org/2025-01-15/12-00/two.csv.gz"]
    for i, key in enumerate(keys):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(gzip.compress(f"a,b\n{i},x\n".encode(), mtime=0))
    content = [(tmp_path / k).read_bytes() for k in keys]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame(
        [("f1", "b", keys[0], len(content[0]), sha(content[0]).upper()), ("f2", "b", "a1/x.org/2025-01-15/12-00/three.csv.gz", 5, "ab")],
        "file_id string, batch_id string, s3_key string, file_size long, checksum string",
    )
    found = landing.inventory(spark, str(tmp_path))
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.partition("ReadSchema")[2]
    assert {(r["account_id"], r["domain"], r["started_at"], r["original_file_name"]) for r in found.collect()} == {("a1", "x.org", datetime(2025, 1, 15, 12, 0), n) for n in ("one.csv.gz", "two.csv.gz")}
    stored = landing.digests(spark, str(tmp_path))
    kinds = {(r["s3_key"].rpartition("/")[2], r["kind"]) for r in quality.storage_difference(files, stored).collect()}
    assert kinds == {("two.csv.gz", "ORPHAN_OBJECT"), ("three.csv.gz", "MISSING_OBJECT")}
    assert {r["file_id"]: r["matches"] for r in landing.verified(files, stored).collect()} == {"f1": True, "f2": False}
    rows = landing.read_uploads(spark, str(tmp_path), "a int, b string", files=files).collect()
    assert {(r["a"], r["file_id"]) for r in rows} == {(0, "f1"), (1, None)}


def test_month_pruning_needs_no_scan_of_others(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 5), "2024_01"), (datetime(2024, 5, 5), "2024_05")], "occurred_at timestamp_ntz, ym string")
    df.withColumns({"error_id": F.lit("x"), "site_id": F.lit("s")}).write.partitionBy("ym").parquet(str(tmp_path / "p"))
    got = tables.load_errors(spark, str(tmp_path / "p"), datetime(2024, 5, 1))
    assert len(got.inputFiles()) >= 1 and got.count() == 1


def test_exports_have_order_and_headers(spark, tmp_path):
    """An empty export is its header; one of several parts has it in each, and the parts in order are newest first."""
    from ingestlens.sources import export

    rows = [(i, None, 7, "T", "a, b", None, datetime(2024, 1, 1 + i * 7 % 28, i % 24)) for i in range(400)]
    errors = spark.createDataFrame(rows, "error_id long, batch_id long, site_id long, type string, message string, metadata string, occurred_at timestamp_ntz")
    for dialect in export.DIALECTS:
        export.write_csv(errors.limit(0), str(tmp_path / f"none-{dialect}"), dialect)
        assert [r["value"] for r in spark.read.text(str(tmp_path / f"none-{dialect}")).collect()] == [export.DIALECTS[dialect][0]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_csv(errors, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "parts").glob("part-*"))]
    assert len(parts) > 1 and all(p[0] == export.DIALECTS["admin"][0] for p in parts)
    want = sorted(rows, key=lambda r: (r[6], r[0]), reverse=True)
    assert [line.split(",")[0] for p in parts for line in p[1:]] == [str(r[0]) for r in want]


def test_landing_is_dealt_by_folders(spark, tmp_path):
    """Many small folders are several tasks' work, each still one object; a busy folder is cut, a null domain is one like others."""
    from ingestlens.sources import export

    day = datetime(2024, 1, 1)
    small = [("a", f"d{i % 7}", day + timedelta(minutes=i), i) for i in range(60)] + [("a", None, day, 60)]
    rows = spark.createDataFrame(small + [("b", "busy", day, 100 + i) for i in range(50)], "account_id string, domain string, started_at timestamp_ntz, error_id long")
    export.write_landing(rows, str(tmp_path / "l"), object_rows=10, task_folders=5)
    found = [p for p in (tmp_path / "l").rglob("part-*.parquet")]
    per_folder = Counter(p.parent for p in found)
    assert 1 < per_folder.pop(tmp_path / "l/account_id=b/domain=busy/d=2024-01-01/t=00-00") <= 5
    assert len(per_folder) == 61 and set(per_folder.values()) == {1}
    assert len({p.name.split("-")[1] for p in found}) > 5
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "l")).select("error_id").collect()) == sorted([*range(61), *range(100, 150)])
    export.write_landing(rows.limit(0), str(tmp_path / "none"))


def test_landing_csv_equals_sparks_writer(spark, tmp_path):
    """Local CSV objects have the folders and lines of Spark's own writer, with awkward names and texts, and are made without a process for each file."""
    from ingestlens.sources import export

    day = datetime(2024, 1, 1, 5, 7, 9, 120000)
    texts = ["plain", "a,b", 'say "x"', "two\nlines", " blanks ", "", None, "back\\slash", "é", "#no comment", "'"]
    rows = [(f"a{i % 3}", d, day + timedelta(minutes=i), i, t) for i, t in enumerate(texts) for d in ("x.org", None, "", "a=b/c d%[]^é", "it's")]
    table = spark.createDataFrame(rows, "account_id string, domain string, started_at timestamp_ntz, error_id long, text string")
    export.write_landing(table, f"file://{tmp_path}/ours", "csv", task_folders=5)
    keys = ["account_id", "domain", "d", "t"]
    table.withColumns({"d": F.date_format("started_at", "yyyy-MM-dd"), "t": F.date_format("started_at", "HH-mm")}).write.partitionBy(*keys).csv(str(tmp_path / "sparks"))

    def found(top):
        out = {}
        for p in (tmp_path / top).rglob("part-*"):
            out.setdefault(str(p.parent.relative_to(tmp_path / top)), []).append(p.read_text())
        return {k: sorted("".join(v).split("\n")) for k, v in out.items()}

    assert found("ours") == found("sparks") and (tmp_path / "ours/_SUCCESS").exists()
    assert not list((tmp_path / "ours").rglob(".*"))  # Hadoop's local file system leaves a checksum file, made by a process, for each
    export.write_landing(table.limit(0), str(tmp_path / "none"), "csv")
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]
    assert export._local_path(spark, "hdfs://h/x") is None and export._local_path(spark, "s3a://b/x") is None


def test_landing_counts_need_no_partition_discovery(spark):
    """The folders are known by the objects' keys; none of them is a partition that the driver keeps."""
    from ingestlens.plans import storage

    leaf = storage.snk5(spark, SMALL)._jdf.queryExecution().optimizedPlan().collectLeaves().head()
    assert leaf.relation().partitionSchema().length() == 0
