"""Pages by a rank index, references in one shuffle, duplicates of a frequent digest."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ingestlens.operators import paging, quality
from ingestlens.plans.views import model


def test_ranked_pages_equal_sorted_ones(spark, tmp_path):
    """Every page, with ties in the sort column, is PAG1's; one deep page reads at most two ranges."""
    rows = spark.range(5000).select(F.col("id").alias("batch_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("started_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        paging.build_rank_index(rows, "batch_id", str(tmp_path / "i"), "startedAt,desc")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ranges = spark.read.parquet(f"{tmp_path}/i/counts").count()
    assert ranges > 10
    ordered = sorted(((r["started_at"], r["batch_id"]) for r in rows.collect()), reverse=True)
    for number, size in [(0, 20), (3, 20), (130, 37), (249, 20), (250, 20), (9999, 20), (1, 3000)]:
        got = paging.ranked_page(spark, str(tmp_path / "i"), "batch_id", number, size, "startedAt,desc")
        assert [(r["started_at"], r["batch_id"]) for r in got.collect()] == ordered[number * size : number * size + size]
    deep = paging.ranked_page(spark, str(tmp_path / "i"), "batch_id", 200, 20, "startedAt,desc", totals=True)
    assert len({re.search(r"_range=(\d+)", f)[1] for f in deep.inputFiles()}) == ranges  # all are listed,
    wanted = re.search(r"PartitionFilters: \[.*?_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", deep._jdf.queryExecution().executedPlan().toString())
    assert len((wanted[1] or wanted[2]).split(",")) <= 2  # two at most are read
    assert {(r["page"], r["size"], r["total_elements"], r["total_pages"]) for r in deep.collect()} == {(200, 20, 5000, 250)}
    with pytest.raises(ValueError, match="page"):
        paging.ranked_page(spark, str(tmp_path / "i"), "batch_id", -1)
    paging.build_rank_index(rows.limit(0), "batch_id", str(tmp_path / "none"), "startedAt,desc")
    assert paging.ranked_page(spark, str(tmp_path / "none"), "batch_id", 0, 20, "startedAt,desc").count() == 0


def test_references_take_one_scan_each(spark):
    accounts = spark.createDataFrame([("a",)], "account_id string")
    sites = spark.createDataFrame([("s", "a"), ("t", "x"), ("u", None)], "site_id string, account_id string")
    batches = spark.createDataFrame([("b", "s", "a"), ("c", "zz", "x"), ("d", None, None)], "batch_id string, site_id string, account_id string")
    files = spark.createDataFrame([("b",)] * 5 + [("q",)] * 3 + [(None,)], "batch_id string")
    errors = spark.createDataFrame([("s", "b"), ("zz", None), ("t", "q")], "site_id string, batch_id string")
    got = {r["reference"]: r["violations"] for r in quality.referential_report(accounts, sites, batches, files, errors).collect()}
    assert got == {"site.account": 1, "batch.site": 1, "batch.account": 1, "file.batch": 3, "error.site": 1, "error.batch": 1}
    none = [d.limit(0) for d in (accounts, sites, batches, files, errors)]
    assert [r["violations"] for r in quality.referential_report(*none).collect()] == [0] * 6
    m = model(spark, SMALL)
    plan = quality.referential_report(m["accounts"], m["sites"], spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr("o_orderkey batch_id", "o_custkey site_id", "0 account_id"), m["files"], m["errors"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 5 and text.count("Join") == 0 and text.count("Exchange") == 2


def test_frequent_digest(spark):
    files = spark.createDataFrame([(b, "AA") for b in [1, 1, 2, 3, 3, 3]] + [(1, "bb"), (4, "cc"), (4, "CC"), (5, None), (5, None), (9, "aa")], "batch_id long, checksum string")
    batches = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, None), (5, "t")], "batch_id long, site_id string")
    got = {(r["checksum"], r["files"], r["batches"], r["sites"]) for r in quality.content_duplicates(files, batches).collect()}
    assert got == {("aa", 6, 3, 2), ("cc", 2, 1, 0), (None, 2, 1, 1)}
