"""Rules and boundaries on hand-written rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.operators import filters, joins, lifecycle, paging, quality, stats
from ingestlens.schemas import STATUSES
from ingestlens.sources import export, partitions

T0 = datetime(2025, 1, 15, 12, 0)


@pytest.fixture(scope="module")
def small(spark):
    """Three accounts (one inactive), sites, batches with drift, files, errors."""
    accounts = spark.createDataFrame([("a1", "A@x.org", "One", True), ("a2", "b@x.org", "Two", True), ("a3", "c@x.org", "Three", False)], "account_id string, email string, name string, is_active boolean")
    sites = spark.createDataFrame(
        [("s1", "a1", "one.org", "S1", True), ("s2", "a1", "two.org", "S2", False), ("s3", "a2", "three.org", "S3", True), ("s4", "a3", "four.org", "S4", True)],
        "site_id string, account_id string, domain string, display_name string, is_active boolean",
    )
    batches = spark.createDataFrame(
        [
            ("b1", "a1", "s1", "COMPLETED", 5, 5120, False, T0, T0 + timedelta(minutes=5)),
            ("b2", "a1", "s1", "IN_PROGRESS", 1, 1024, False, T0, None),
            ("b3", "a2", "s3", "FAILED", 3, 10, True, T0, T0 + timedelta(minutes=9)),
        ],
        "batch_id string, account_id string, site_id string, status string, uploaded_files_count int, total_size long, has_errors boolean, started_at timestamp_ntz, completed_at timestamp_ntz",
    )
    files = spark.createDataFrame(
        [("f1", "b1", "x.csv", 1024, "checksum1", T0), ("f2", "b1", "y.csv", 2048, "ab12", T0), ("f3", "b2", "x.csv", 1024, "AB12", T0)],
        "file_id string, batch_id string, original_file_name string, file_size long, checksum string, uploaded_at timestamp_ntz",
    )
    errors = spark.createDataFrame(
        [("e1", "s3", "b3", "T1", 'a, "b"\nc', '{"k": 1}', T0), ("e2", "s1", None, "T2", "plain\r", None, T0 + timedelta(microseconds=120000)), ("e3", "s1", "b3", "T2", " lead", "{}", T0)],
        "error_id string, site_id string, batch_id string, type string, message string, metadata string, occurred_at timestamp_ntz",
    )
    return {"accounts": accounts, "sites": sites, "batches": batches, "files": files, "errors": errors}


def ids(df, key):
    return sorted(r[key] for r in df.collect())


def test_status_pairs(spark):
    rows = [(a, b) for a in STATUSES for b in STATUSES]
    got = spark.createDataFrame(rows, "a string, b string").filter(lifecycle.may_become("a", "b")).collect()
    assert sorted(map(tuple, got)) == sorted(("IN_PROGRESS", b) for b in STATUSES[1:])


def test_expiry_is_strict(spark):
    rows = [("exact", T0 - timedelta(minutes=60)), ("more", T0 - timedelta(minutes=60, microseconds=1)), ("new", T0)]
    b = spark.createDataFrame(rows, "batch_id string, started_at timestamp_ntz").withColumns({"status": F.lit("IN_PROGRESS"), "site_id": F.lit("s"), "account_id": F.lit("a"), "completed_at": F.lit(None).cast("timestamp_ntz")})
    assert ids(filters.expired(b, T0), "batch_id") == ["more"]
    once, events = lifecycle.sweep(b, T0)
    twice, again = lifecycle.sweep(once, T0)
    assert ids(events, "batch_id") == ["more"] and again.count() == 0
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_remaining_minutes(spark):
    rows = spark.createDataFrame([(T0, "IN_PROGRESS"), (T0 - timedelta(minutes=59, seconds=30), "IN_PROGRESS"), (T0 - timedelta(hours=3), "IN_PROGRESS"), (T0, "FAILED")], "t timestamp_ntz, s string")
    got = rows.select(S.remaining_minutes(F.col("t"), F.col("s"), F.lit(T0).cast("timestamp_ntz"), 60).alias("m")).collect()
    assert [r["m"] for r in got] == [60, 0, 0, 0]


@pytest.mark.parametrize(
    ("day", "name", "first", "past", "following"),
    [
        (date(2025, 1, 31), "error_logs_2025_01", date(2025, 1, 1), date(2025, 2, 1), date(2025, 2, 1)),
        (date(2025, 12, 5), "error_logs_2025_12", date(2025, 12, 1), date(2026, 1, 1), date(2026, 1, 1)),
        (date(2024, 2, 29), "error_logs_2024_02", date(2024, 2, 1), date(2024, 3, 1), date(2024, 3, 1)),
    ],
)
def test_months(spark, day, name, first, past, following):
    c = F.lit(day)
    assert tuple(spark.range(1).select(S.partition_name(c), S.month_start(c), S.month_end(c), S.next_month(c)).first()) == (name, first, past, following)


def test_retention_must_be_positive():
    with pytest.raises(ValueError):
        S.retention_cutoff("x", 0)


def test_emails_and_domains(spark):
    rows = [("a@b.co", True), ("a b@c.co", False), ("a@b", False), ("A+x_y.z-1@B-c.info", True), ("@b.co", False)]
    got = spark.createDataFrame(rows, "e string, ok boolean").filter(S.is_email("e") != F.col("ok"))
    assert got.count() == 0
    domains = [("ab", False), ("abc", True), ("Abc", False), ("a_b.org", False), ("x" * 255, True), ("x" * 256, False)]
    assert spark.createDataFrame(domains, "d string, ok boolean").filter(S.is_domain("d") != F.col("ok")).count() == 0


def test_case_insensitive_lookup(small):
    assert ids(filters.by_text(small["accounts"], "email", "a@X.ORG"), "account_id") == ["a1"]
    assert filters.existing(small["accounts"].select(F.upper("email").alias("email")), small["accounts"], "email").count() == 3


def test_unknown_status_and_sort(small):
    with pytest.raises(ValueError):
        filters.batch_list(small["batches"], status="DONE")
    with pytest.raises(ValueError):
        paging.page(small["batches"], "batch_id", sort="nope,asc")
    with pytest.raises(ValueError):
        paging.page(small["batches"], "batch_id", number=-1, sort="started_at")


def test_metadata_rules(spark):
    entries = lambda n: "{" + ",".join(f'"k{i}":1' for i in range(n)) + "}"
    sized = lambda n: '{"k":"' + "x" * (n - 8) + '"}'
    cases = [
        (None, None), ("{}", None), (entries(20), None), (entries(21), "METADATA_ENTRIES"), ('{"' + "k" * 100 + '":1}', None), ('{"' + "k" * 101 + '":1}', "METADATA_KEY_LENGTH"),
        ('{"":1}', "METADATA_EMPTY_KEY"), (sized(10_240), None), (sized(10_241), "METADATA_SIZE"), ('{"a":{"b":[1,2]}}', None), ("{bad", "METADATA_INVALID"),
        ('{"a":1,"a":2}', "METADATA_INVALID"), ("[1]", "METADATA_INVALID"), ('{ "k" :  "' + "x" * (10_240 - 8) + '" }', None),
    ]
    df = spark.createDataFrame(cases, "metadata string, want string").withColumn("got", quality.metadata_reason())
    assert [tuple(r) for r in df.filter(~F.col("got").eqNullSafe(F.col("want"))).select("want", "got").collect()] == []


def test_admission_order(spark, small):
    files = spark.createDataFrame(
        [("1", "b2", "n", 0), ("2", "none", "n", 1), ("3", "b1", "n", 1), ("4", "b2", "n", 134217729), ("5", "b2", " ", 5), ("6", "b2", "n", 134217728), ("7", "b2", "n", 1), ("8", "b2", "N", 1)],
        "file_id string, batch_id string, original_file_name string, file_size long",
    ).withColumn("uploaded_at", F.lit(T0))
    got = {r["file_id"]: r["reason"] for r in quality.admission(files, small["batches"]).collect()}
    assert got == {"1": "EMPTY_FILE", "2": "BATCH_NOT_FOUND", "3": "BATCH_NOT_OPEN", "4": "TOO_LARGE", "5": "NAME_BLANK", "6": None, "7": "DUPLICATE_NAME", "8": None}


def test_first_uploads_without_names(spark):
    rows = [("1", "b", "n"), ("2", "b", "n"), ("3", "b", None), ("4", "b", None), ("4", "b", None), ("5", None, "n"), ("6", None, "n")]
    files = spark.createDataFrame(rows, "file_id string, batch_id string, original_file_name string").withColumn("uploaded_at", F.lit(T0))
    first, later = quality.first_uploads(files)
    assert sorted(r["file_id"] for r in first.collect()) == ["1", "3", "4", "4", "5", "6"] and [r["file_id"] for r in later.collect()] == ["2"]


def test_storage_difference_kinds(spark):
    files = spark.createDataFrame([("same", 1, "AB"), ("size", 2, "ab"), ("both", 2, "cd"), ("gone", 3, "ab"), (None, 4, "ab")], "s3_key string, file_size long, checksum string")
    there = spark.createDataFrame([("same", 1, "ab"), ("size", 1, "ab"), ("both", 1, "ab"), ("extra", 1, "ab")], "s3_key string, stored_size long, stored_checksum string")
    got = sorted((r["s3_key"] or "", r["kind"]) for r in quality.storage_difference(files, there).collect())
    assert got == [("", "MISSING_OBJECT"), ("both", "DIGEST_MISMATCH"), ("both", "SIZE_MISMATCH"), ("extra", "ORPHAN_OBJECT"), ("gone", "MISSING_OBJECT"), ("size", "SIZE_MISMATCH")]
    sizes = quality.storage_difference(files, there.drop("stored_checksum"))
    assert sizes.filter("kind = 'DIGEST_MISMATCH'").count() == 0 and sizes.count() == 5


def test_audits(small):
    m = small
    assert {(r["kind"], r["id"]) for r in quality.tenancy_audit(m["accounts"], m["sites"], m["batches"], m["errors"]).collect()} == {("FOREIGN_ERROR", "e3"), ("ACTIVE_SITE_INACTIVE_ACCOUNT", "s4")}
    _, rejected = quality.validate(m["files"], "uploaded_files")
    assert [(r["file_id"], r["reasons"]) for r in rejected.collect()] == [("f1", ["CHECKSUM_FORMAT"])]
    assert quality.content_duplicates(m["files"], m["batches"]).collect()[0]["files"] == 2
    drift = {r["batch_id"]: (r["files_delta"], r["bytes_delta"]) for r in stats.counter_drift(m["batches"], m["files"], m["errors"]).collect()}
    assert drift == {"b1": (3, 2048), "b3": (3, 10)}


def test_statistics_have_zero_rows(small):
    got = {r["account_id"]: r for r in stats.account_statistics(*(small[k] for k in ("accounts", "sites", "batches", "files", "errors"))).collect()}
    assert (got["a1"]["batches"], got["a1"]["files"], got["a1"]["bytes"], got["a1"]["errors"]) == (2, 3, 4096, 2)
    assert (got["a3"]["batches"], got["a3"]["files"], got["a3"]["sites"]) == (0, 0, 1)


def test_empty_tables(small):
    empty = {k: v.limit(0) for k, v in small.items()}
    assert stats.account_statistics(*(empty[k] for k in ("accounts", "sites", "batches", "files", "errors"))).count() == 0
    assert stats.global_statistics(*(empty[k] for k in ("accounts", "sites", "batches", "files", "errors"))).first()["bytes"] == 0


def test_outcomes(small):
    for exact in (True, False):
        got = {r["status"]: r for r in stats.outcomes(small["batches"], exact).collect()}
        assert (got["COMPLETED"]["p50_seconds"], got["FAILED"]["p95_seconds"], got["IN_PROGRESS"]["p50_seconds"]) == (300.0, 540.0, None)


def test_nested_details(small):
    got = {r["batch_id"]: [f["file_id"] for f in r["files"]] for r in joins.batch_details(small["batches"], small["files"], small["sites"]).collect()}
    assert got == {"b1": ["f1", "f2"], "b2": ["f3"], "b3": []}


def test_commands(spark, small):
    commands = spark.createDataFrame(
        [("b2", "s1", "FAIL", T0), ("b2", "s1", "COMPLETE", T0 + timedelta(1)), ("b1", "s1", "CANCEL", T0), ("b3", "s1", "CANCEL", T0), ("zz", "s1", "FAIL", T0)],
        "batch_id string, site_id string, action string, at timestamp_ntz",
    )
    done, rejected = lifecycle.apply_commands(small["batches"], commands)
    row = done.filter("batch_id = 'b2'").first()
    assert (row["status"], row["has_errors"], row["completed_at"]) == ("FAILED", True, T0)
    assert sorted((r["batch_id"], r["reason"]) for r in rejected.collect()) == [("b1", "NOT_OPEN"), ("b2", "NOT_OPEN"), ("b3", "FOREIGN_SITE"), ("zz", "NOT_FOUND")]


def test_cascades(spark, small):
    stamped = lambda k: small[k].withColumn("updated_at", F.lit(T0).cast("timestamp_ntz"))
    later = T0 + timedelta(1)
    accounts, sites = lifecycle.deactivate_accounts(stamped("accounts"), stamped("sites"), spark.createDataFrame([("a1",), ("a3",)], "account_id string"), later)
    assert {r["account_id"]: (r["is_active"], r["updated_at"] == later) for r in accounts.collect()} == {"a1": (False, True), "a2": (True, False), "a3": (False, False)}
    assert {r["site_id"]: (r["is_active"], r["updated_at"] == later) for r in sites.collect()} == {"s1": (False, True), "s2": (False, False), "s3": (True, False), "s4": (True, False)}
    changed = lifecycle.change(stamped("sites"), spark.createDataFrame([("s1", " New "), ("s3", " "), ("s2", "S2")], "site_id string, display_name string"), "sites", later)
    assert {r["site_id"]: (r["display_name"], r["updated_at"] == later) for r in changed.collect()} == {"s1": ("New", True), "s2": ("S2", False), "s3": ("S3", False), "s4": ("S4", False)}
    b, f, e = lifecycle.delete_batches(small["batches"], small["files"], small["errors"], spark.createDataFrame([("b1",), ("b3",)], "batch_id string"))
    assert (ids(b, "batch_id"), ids(f, "file_id"), ids(e, "error_id")) == (["b2"], ["f3"], ["e2"])


def test_csv_bytes(small):
    rows = {r["value"] for r in export.csv_rows(small["errors"], "admin").collect()}
    assert 'e1,b3,s3,T1,"a, ""b""\nc","{""k"": 1}",2025-01-15 12:00:00' in rows
    assert "e2,,s1,T2,plain\r,,2025-01-15 12:00:00" in rows
    service = {r["value"] for r in export.csv_rows(small["errors"], "service").collect()}
    assert "e2,,s1,T2,plain\r,2025-01-15T12:00:00.12," in service and "e3,b3,s1,T2, lead,2025-01-15T12:00:00," in service


def test_csv_files(small, tmp_path):
    export.write_csv(small["errors"], str(tmp_path / "out"), "admin", single_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    lines = part.read_bytes().split(b"\n")
    assert lines[0] == b"ID,Batch ID,Site ID,Type,Message,Metadata,Occurred At" and lines[1].startswith(b"e2,")


def test_coverage(small):
    got = {r["ym"]: r["present"] for r in partitions.coverage(small["errors"], datetime(2024, 12, 1), datetime(2025, 1, 3)).collect()}
    assert got == {"2024_12": False, "2025_01": True, "2025_02": False}
