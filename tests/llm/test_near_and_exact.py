"""Exact and near duplicates against brute force, with awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ingestlens.llm import near_dedup, registry, shingles
from ingestlens.llm.common import maybe_among
from ingestlens.llm.components import components
from ingestlens.llm.exact_dedup import exact_dedup, keep_one

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "ab c"), (6, "a  b c"), (7, "x"), (7, "x"), (8, "é x"), (None, "x"), (None, None), (9, "word " * 30_000)]


def frame(spark, rows):
    """Documents with extra columns that clash with result names."""
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, kept string, component_id int")


def test_sql(spark, duck):
    for name in registry.ORACLE_SQL:
        same_rows(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLE_SQL[name]))


def test_exact_rules(spark):
    got = exact_dedup(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    norm = {}
    for i, t in ODD:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        group = norm[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")]
        keep = min(group, key=lambda g: g[:3])[3]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()
    assert exact_dedup(frame(spark, ODD).limit(0)).count() == 0


def test_keep_one(spark):
    odd = [(1, "a b"), (1, "a   b"), (2, "ab"), (5, None), (5, ""), (None, "q"), (None, "q"), (7, " q "), (9, "x y"), (9, "x y"), (None, "z"), (None, "z")]
    got = keep_one(frame(spark, odd))
    assert got.columns == frame(spark, odd).columns
    rows = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert rows == sorted([(1, "a   b"), (5, ""), (7, " q "), (9, "x y"), (None, "z")], key=str)
    assert keep_one(frame(spark, odd).limit(0)).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = {r["doc_id"] for r in exact_dedup(docs).filter("kept").collect()}
    kept = [r["doc_id"] for r in keep_one(docs).collect()]
    assert sorted(kept) == sorted(marked)


def brute(rows, percent=75):
    """Component per id by comparing all pairs of word 5-gram sets of strings."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    rows, base = [], [list(rng.choice(words, 60)) for _ in range(6)]
    for i in range(160):  # graded copies, so that chains form and pivots are not enough
        text = list(base[i % 6])
        for _ in range(rng.integers(0, 4)):
            text[rng.integers(0, len(text))] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE\ttwo"), (504, "one two three"), (505, " ")]
    want = brute(rows)
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_near_odd_rows(spark):
    got = near_dedup.near_groups(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["id"]: r for r in got if r["id"] is not None}
    assert by[4]["component_id"] == 4 and by[6]["component_id"] == 4 and by[5]["component_id"] == 5
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (1, 2, 3))
    assert by[9]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in got if r["id"] is None)
    assert near_dedup.near_groups(frame(spark, ODD).limit(0)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    text = list(rng.choice(words, 80))
    rows = []
    for i in range(40):  # a drift: neighbours are similar, ends are not
        text = list(text)
        text[rng.integers(0, 80)] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
    assert {r["id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, rows)).collect()} == {i: c for i, (_, c) in brute(rows).items()}


def test_template_pages_are_not_compared(spark, monkeypatch):
    """Pages of one template, similarity about 0.49: candidates of each other, no links; none of their texts goes into blocks."""
    seen = []
    across = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda rows, *a: seen.append(rows.count()) or across(rows, *a))
    rng = np.random.default_rng(9)
    template = " ".join(f"t{i}" for i in range(120))
    for n in (150, 300):
        rows = [(i, template + " " + " ".join(f"x{rng.integers(0, 10**9)}" for _ in range(58))) for i in range(n)]
        rows += [(1000 + i, rows[i][1] + " tail") for i in range(9)]  # and some real copies
        got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, rows)).collect()}
        assert got == {i: i % 1000 for i, _ in rows}
    assert max(seen) < 40


def test_only_likely_pairs_send_texts(spark, monkeypatch):
    """Pages of one template, similarity about 0.3, share buckets; none of their texts is sent to be verified, and a pair goes once."""
    seen = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a: seen.extend((r["u"]["id"], r["v"]["id"]) for r in pairs.collect()) or verified(pairs, *a))
    rng = np.random.default_rng(11)
    template = " ".join(f"t{i}" for i in range(90))
    rows = [(i, template + " " + " ".join(f"x{rng.integers(0, 10**9)}" for _ in range(95))) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(9)]
    got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert sorted(sorted(p) for p in seen) == [[i, 1000 + i] for i in range(9)]


def test_busy_end_is_met_in_parts(spark, monkeypatch):
    """Members of one end are dealt to parts by their number, each with one row of the end; a few members share one."""
    monkeypatch.setattr(near_dedup, "PART_MEMBERS", 10)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 101)] + [(i, 500) for i in range(501, 508)], "u long, v long")
    facts = spark.createDataFrame([(i, f"t{i}") for i in range(600)], "id long, text string")
    rows = near_dedup._with_ends(pairs, facts).collect()
    assert sorted((r["u"], r["v"], r["text"]) for r in rows if r["member"]) == sorted((u, v, f"t{u}") for u, v in ((r["u"], r["v"]) for r in pairs.collect()))
    ends = [(r["v"], r["text"]) for r in rows if not r["member"]]
    assert ends.count((500, "t500")) == 1 and 5 <= ends.count((0, "t0")) <= 10 and len(ends) == ends.count((0, "t0")) + 1


def test_filter_misses_no_row(spark):
    wanted = spark.range(0, 3000, 3).withColumn("k", F.lit("1"))
    rows = spark.range(30000).withColumn("k", F.lit("1"))
    got = {r["id"] for r in maybe_among(rows, wanted, "id", "k").collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1600
    assert maybe_among(rows, wanted.limit(0), "id", "k").count() == 0


def test_kept_texts_are_not_shuffled(spark):
    """The pipeline drops near copies by a list; a text that is surely not on it does not travel."""
    import corpus_pipeline

    base = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, base(k)) for k in range(40)] + [(100 + k, base(k) + " more") for k in range(4)] + [(None, base(1)), (200, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    left = corpus_pipeline.keep_one_of_near(spark, docs, SMALL)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([*range(40), None, 200], key=str)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.index("Union") < plan.index("LeftAnti")


def test_near_two_texts_of_one_id(spark):
    """An id with two texts has the links of both, and only rows that are like another go."""
    import corpus_pipeline

    base = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, base(1)), (5, base(1) + " more"), (5, base(2)), (7, base(2) + " more"), (7, base(2) + " more"), (9, base(3)), (9, base(3) + " more"), (None, base(3))]
    got = near_dedup.near_groups(frame(spark, rows))
    assert sorted((r["id"] or 0, r["component_id"] or 0) for r in got.collect()) == [(0, 0), (1, 1), (5, 1), (5, 5), (7, 5), (7, 5), (9, 9), (9, 9)]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near(spark, docs, SMALL).collect()]
    assert sorted(left, key=str)[:3] == sorted([(1, base(1)), (5, base(2))] + [r for r in left if r[0] == 9], key=str) and len(left) == 4
    # Many ids with two texts each, each text with a near copy: every link is found.
    many = [(k, base(100 + k)) for k in range(20)] + [(k, base(200 + k)) for k in range(20)] + [(100 + k, base(100 + k) + " a") for k in range(20)] + [(200 + k, base(200 + k) + " b") for k in range(20)]
    found = {r["id"]: r["component_id"] for r in near_dedup.near_groups(frame(spark, many)).collect()}
    assert all(found[100 + k] == k and found[200 + k] == k for k in range(20))


def test_near_text_ids(spark):
    rows = [(f"k{i}", f"one two three four five six seven eight {'x' * (i % 2)} nine") for i in range(6)]
    got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {f"k{i}": f"k{i % 2}" for i in range(6)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "\t", "\n", " ", "\x0b", " ", "x1"]), max_size=40))
def test_shingles_equal_strings(parts):
    text = " ".join(parts)
    w = text.encode().lower().split()
    k = min(5, len(w))
    want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    assert len(shingles.shingle_set(text)) == len(want)


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300])
def test_signatures_fill_and_agree(n):
    s = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    a = shingles.super_minhash([s, np.empty(0, np.uint64), s], 128)
    assert np.isfinite(a[0]).all() and (a[0] == a[2]).all() and np.isinf(a[1]).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 90, 95: 90, 90: 90}
    assert components(links.limit(0)).count() == 0
