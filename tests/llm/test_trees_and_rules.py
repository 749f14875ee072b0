"""Manifest, prefix trie and n-gram rules against plain Python, with awkward rows."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from contextlib import contextmanager, redirect_stdout

import pytest
from pyspark.sql import functions as F

from ingestlens.llm import manifest, ngram_rules, prefix_trie


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@contextmanager
def fixed_partitions(spark, n):
    """Rows stay in as many tasks as a shuffle deals them to, so that groups cross from one task into the next."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# Manifest


def plain_manifest(rows, tamper):
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded root)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))

    def tree(nodes):
        """Root, and per node its (before, after) level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(at):
                run = nodes[p // 3 * 3 : p // 3 * 3 + 3]
                paths[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
            at = [p // 3 for p in at]
        return nodes[0], paths

    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in order:
        mine = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        found[s] = mine, *tree([leaf(r, r[4]) for r in mine])
    root, tops = tree([found[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        mine, sub, paths = found[s]
        for r, path in zip(mine, paths, strict=True):
            h = leaf(r, tamper(r))
            for before, after in path + top:
                h = sha(before + h + after)
            out.append((r[0], leaf(r, r[4]), sub, root, sha("".join(b + a for b, a in path + top)), h, h == root))
    return sorted(out, key=str)


def documents(n, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "é", "z", None, ""]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "ü" * rng.randint(1, 9), "\n"])) for i in range(n)]
    return rows + [(None, "a", None, None, None), (None, None, None, None, None), (3, "a", None, None, "again"), (3, "a", None, None, "again"), (-7, "z", "en", 1, "word\n" * 50_000)]


@pytest.mark.parametrize(("n", "levels"), [(0, 6), (1, 6), (40, 1), (150, 2), (200, 6)])
def test_manifest(spark, monkeypatch, n, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = documents(n) if n > 1 else [(5, "s", None, 2, "a\nb")] * n
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string")
    with fixed_partitions(spark, 5):
        got = manifest.manifest(docs, F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))).collect()
    want = plain_manifest(rows, lambda r: r[4].replace("\n", "") if r[4] and r[0] is not None and r[0] % 2 == 0 else r[4]) if rows else []
    assert sorted(map(tuple, got), key=str) == want
    untouched = manifest.manifest(docs)
    assert untouched.filter("not verified").count() == 0


# Trie


def plain_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[p]) if kids[p] else 1
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(sums[k][1] for k in kids[p])
        sums[p] = leaves, saved
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums[p], sha(ends)))
    return sorted(out, key=str)


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        if c % 7 != 3:
            for t in range(rng.choice([1, 2, 3, 9, 12])):
                rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None, ""]) if t else "user", rng.choice(["a", "é", "", None, "a long one", str(c)]) if t > 1 else rng.choice(["hi", "ho"])))
    return rows + [(None, 1, "user", "of nobody"), (n, 0, "user", "x" * 200_000), (n + 1, None, None, None), (n + 1, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(60, seed) + [(1000, t, "user", str(t % 5)) for t in range(300)] + [(1000 + 5 * k, t, "user", str(t % 5)) for k in range(1, 40) for t in range(12)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    want = plain_trie(rows)
    with fixed_partitions(spark, 6):
        assert sorted(map(tuple, prefix_trie.prefix_trie(turns).collect()), key=str) == want
    assert sorted(map(tuple, prefix_trie.prefix_trie(turns).collect()), key=str) == want
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 1000, 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with fixed_partitions(spark, 4):
        assert sorted(map(tuple, prefix_trie.prefix_trie(turns).collect()), key=str) == plain_trie(rows)


def test_shared_reference_stops(spark):
    rows = spark.createDataFrame([(b"r", "user", "a"), (b"r", "user", "b")], "ref binary, role string, text string")
    with pytest.raises(ValueError, match="share a reference"):
        prefix_trie.check_references(rows)


# Rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text):
    codes = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    m = ngram_rules.BUCKETS
    return [c % m for c in codes] + [(a * 1_000_003 + b) % m for a, b in zip(codes, codes[1:], strict=False)]


def plain_verdicts(docs, good_ids):
    held = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % ngram_rules.HELD == 0 for i in good_ids}
    raw, good = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        if held.get(i) is False:
            good.update(grams(t))
    share = lambda c, b: (c[b] + 1) / (c.total() + ngram_rules.BUCKETS)
    weight = {b: math.floor(math.log(share(good, b) / share(raw, b)) * 1e6 + 0.5) for b in raw}
    score = lambda t: sum(weight[b] for b in grams(t)) // len(grams(t)) if grams(t) else None
    fails = lambda n: n[0] < 50 or 100 * n[4] > 50 * n[0]
    kept = sorted(score(t) for i, t in docs if held.get(i) and not fails(plain_counts(t)))
    at = lambda q: kept[math.ceil(q * len(kept)) - 1]
    least = at(0.25) - 3 * (at(0.75) - at(0.25)) if kept and good else None
    out = []
    for i, t in docs:
        n, s = plain_counts(t), score(t)
        ok = not fails(n) and (least is None or s >= least)
        out.append((i, *n, fails(n), s, ok))
    return sorted(out, key=str)


ODD = [None, "", " \t\r\n", "one", "a b", "a b c", "a b c a b c", "x x x x", "é\x0bß\x0cü # <b>|%&*$", "s s\n\ns s\n s s\n\n", "a\x85b\xa0c d", "l1\r\nl1\r\nl1", "\n".join("w%d" % (k % 90) for k in range(40_000))]


def test_rules(spark):
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice("the of and in to quick brown fox jumps over lazy dog while rain falls".split()) + rng.choice(["", "", ",", "s"]) for _ in range(rng.randint(45, 140)))
    junk = lambda: " ".join(rng.choice("zq$$ QX!! ##k |".split()) + str(rng.randint(0, 99)) for _ in range(80))
    docs = [*enumerate(ODD), *[(100 + k, prose()) for k in range(120)], *[(400 + k, junk()) for k in range(20)], (None, prose()), (100, "twice " * 60), (101, "again")]
    labels = [(i, 1) for i in range(100, 200)] + [(i, 0) for i in range(400, 410)] + [(None, 1), (999, 1), (150, 1)]
    frame = spark.createDataFrame([(i, t, True, 1) for i, t in docs], "doc_id long, text string, kept boolean, n_words int")
    marks = spark.createDataFrame([(i, q) for i, q in labels], "doc_id long, quality int")
    ratio = ngram_rules.fit(frame, marks)
    got = sorted(map(tuple, ngram_rules.judge(frame, ratio).collect()), key=str)
    assert got == plain_verdicts(docs, {i for i, q in labels if q == 1 and i is not None})
    kept = {r[0] for r in got if r[-1]}
    assert not kept & set(range(400, 420)) and len(kept & set(range(102, 220))) > 100
    assert ngram_rules.judge(frame.limit(0), ratio).count() == 0
    # Without trusted rows only the fixed rules decide.
    free = ngram_rules.fit(frame, marks.limit(0))
    assert free.threshold is None
    assert ngram_rules.judge(frame, free).filter("kept = base_failed").count() == 0
    assert ngram_rules.fit(frame.limit(0), marks).threshold is None


def test_all_trusted_rows_count(spark):
    """More trusted rows than were once taken: none is left out."""
    labels = spark.range(60_000).selectExpr("id as doc_id", "1 as quality")
    assert ngram_rules.trusted_ids(labels).count() == 60_000


def test_rules_shuffle_no_text(spark, monkeypatch):
    """One plan, whatever Spark may broadcast, and no exchange in it has the texts."""
    stored, seen = ngram_rules.stored, []
    monkeypatch.setattr(ngram_rules, "stored", lambda df, name: seen.append(df) or stored(df, name))
    docs = spark.range(60).selectExpr("id as doc_id", "array_join(transform(sequence(1, 80), i -> concat('w', id, '_', i)), ' ') as text")
    labels = spark.range(50).selectExpr("id as doc_id", "1 as quality")
    joins, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for bound in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
            seen.clear()
            assert ngram_rules.fit(docs, labels).threshold is not None
            out = io.StringIO()
            with redirect_stdout(out):
                for df in seen:
                    df.explain("formatted")
            nodes = re.split(r"\n(?=\(\d+\) )", out.getvalue())
            exchanges = [x for x in nodes if re.match(r"\(\d+\) Exchange", x)]
            assert exchanges and not [x for x in exchanges if re.search(r"\b(text|__words)#", x)]
            joins.append([x.split()[1] for x in nodes if re.match(r"\(\d+\) \w+Join", x)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joins[0] == joins[1] == ["SortMergeJoin"]


def test_rows_without_id_are_dealt_out(spark):
    """Rows without id are trusted by nothing and are no group of their own in the join."""
    rows = spark.range(400).selectExpr("cast(null as long) as doc_id", "id as n_words").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ngram_rules._marked(rows, spark.range(9).selectExpr("id", "true as held"))
        spread = got.filter("held is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r[1] for r in spread) == 400
    assert len(spread) == 4 and max(r[1] for r in spread) < 200


def test_repeats_against_plain_counts(spark):
    """Repeated, overlapping and nearly repeated windows in long texts."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice("ab") + str(rng.randint(0, m)) for _ in range(n)) for m in (0, 3, 40, 4000) for n in (2, 3, 4, 60, 3000)]
    got = ngram_rules.with_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
