"""Quality classifier, language model and the pipeline: brute force, gradients, held-out accuracy, awkward rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from ingestlens.llm import hmm, quality

ODD = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "none id"), (4, "long words " * 30_000), (5, " \t ")]


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in quality.op5_mil_quality(spark, SMALL).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [r for i, r in scored.items() if r["held_out"] and i in labels]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored.values())
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    sizes = [np.array(x) for x in ([0], [4, 0, 2], [1, 1, 3, 2, 2])]
    bags = [quality.Passages(rng.normal(size=(len(n), quality.FEATURES)), rng.integers(0, 9, n.sum()), n) for n in sizes]
    y = np.array([1.0, 0.0, 1.0])
    model = quality.first_model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), 0.6)
    model.p["E"] = rng.normal(size=model.p["E"].shape)
    x, starts = quality.Passages.join(bags), np.array([0, 1, 4])
    grads = model.gradients(model.forward(x, starts), starts, y)

    def loss():
        s = model.forward(x, starts)["score"]
        return -np.sum(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k in ("E", "W", "V", "U", "w", "o"):
        at = tuple(0 for _ in model.p[k].shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_whole_texts_are_grams():
    """Every word of a text of 100,000 counts: its words, its pairs within passages and its endings."""
    words = [f"w{i % 977}" for i in range(100_000)]
    got = quality.passages(" ".join(words))
    last = 100_000 % quality.PASSAGE
    assert len(got) == -(-100_000 // quality.PASSAGE) and got.sizes[-1] == 3 * last - 1 and len(got.grams) == got.sizes.sum() == 300_000 - len(got)
    one = quality.passages("w1 w2")
    assert len(one.grams) == 5 and set(quality.passages("w1").grams) <= set(one.grams)


def test_learns_from_words_and_settles_labels(spark):
    """Texts that differ in one word only; an id with both labels counts half, repeated ids and rows do not change the model."""
    rows = [(i, f"the report of day {i % 7} was {'splendid' if i % 2 else 'dreadful'} to all of them") for i in range(600)]
    labels = [(i, i % 2) for i in range(600)] + [(0, 1), (0, 0)]
    frames = lambda r, la: (spark.createDataFrame(r, "doc_id long, text string"), spark.createDataFrame(la, "doc_id long, quality int"))
    docs, marks = frames(rows, labels)
    model = quality.train(docs, marks)
    got = quality.quality_scores(docs, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    again = quality.train(frames(rows[::-1] + rows[:50], labels)[0].repartition(5), marks.repartition(3))
    assert all((model.p[k] == again.p[k]).all() for k in model.p)


def test_one_passage_of_many_tells_the_label(spark):
    """Twelve passages of the same common words; one of a bad document's has other words. Attention finds it, in rows never learned from."""
    rng = np.random.default_rng(3)
    common, rare = [f"plain{i}" for i in range(200)], [f"odd{i}" for i in range(5)]
    rows, where = [], {}
    for i in range(900):
        text = [list(rng.choice(common, quality.PASSAGE)) for _ in range(12)]
        if i % 2:
            where[i] = int(rng.integers(12))
            text[where[i]][::4] = rng.choice(rare, quality.PASSAGE // 4)
        rows.append((i, " ".join(w for p in text for w in p)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(900)], "doc_id long, quality int"))
    held = [r for r in quality.quality_scores(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.97
    bad = [r for r in held if r["doc_id"] % 2]
    assert np.mean([r["top_passage"] == where[r["doc_id"]] for r in bad]) > 0.9 and np.mean([r["top_weight"] for r in bad]) > 3 / 12


def test_distributed_gradients_equal_one_pass(spark, monkeypatch):
    """Bags in pieces over several tasks, against all bags at once; long bags are cut and joined again."""
    monkeypatch.setattr(quality, "PIECE", 3)
    monkeypatch.setattr(quality, "AT_ONCE", 5)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 50, n))) for i, n in enumerate([0, 1, 64, 65, 900, 300, 2000, 128])]
    kept = []
    monkeypatch.setattr(quality, "fit", kept.append)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][: len(rows)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows, strict=True)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    bags = kept[0]
    assert bags.count() > len(rows) and bags.filter("piece = 0").count() == len(rows)
    x, y = [quality.passages(t) for _, t in rows], np.array([i % 2 for i in ids], float)
    whole = quality.Passages.join(x)
    mean, spread = quality.moments(bags)
    assert mean == pytest.approx(whole.x.mean(0), rel=1e-4, abs=1e-6) and spread == pytest.approx(whole.x.std(0) + 0.02, rel=1e-3, abs=1e-5)
    model = quality.first_model(mean, spread, 0.5)
    model.p["E"] = rng.normal(size=model.p["E"].shape).astype(np.float32)
    lengths = np.array([len(b) for b in x])
    starts = np.cumsum(lengths) - lengths
    want = model.gradients(model.forward(whole, starts), starts, y)
    got, loss = quality.gradients(bags.repartition(3, "id").sortWithinPartitions("id", "piece"), model)
    assert loss > 0 and all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-4) for k in want)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 3.0) for i, t in ODD], "doc_id long, text string, score double")
    for labels in ([], [(3, 1)], [(3, 1), (1, 0), (3, None), (99, 1)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.quality_scores(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(docs.limit(0), model).count() == 0
    assert max(r["n_passages"] for r in got) == math.ceil(60_000 / quality.PASSAGE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


def test_base_scores_and_counts(spark, docs):
    got = {r["doc_id"]: r for r in hmm.hmm_scores(docs).collect()}
    rows = docs.collect()
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b" "] for r in rows}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(t in counts for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tiers_do_not_change_the_base(spark, docs, monkeypatch):
    before = {r["doc_id"]: r["base_score"] for r in hmm.hmm_scores(docs, rounds=1).collect()}
    monkeypatch.setattr(hmm, "COMMON", 50)
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    after = {r["doc_id"]: r["base_score"] for r in hmm.hmm_scores(docs, rounds=1).collect()}
    assert before == pytest.approx(after)


def test_scores_equal_a_plain_model(spark, monkeypatch):
    """Counts, starting point, rounds and scores once more, token by token in plain Python and double precision."""
    monkeypatch.setattr(hmm, "COMMON", 40)
    monkeypatch.setattr(hmm, "SYMBOLS", 12)
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(pool[:30] if i % 2 else pool[20:], rng.integers(0, 90)))) for i in range(60)] + [(100, None), (101, "never seen " + "w1 " * 3000)]
    got = {r["doc_id"]: r for r in hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=3, rounds=2, settled=-1.0, early=0).collect()}
    tokens = {i: [*(t or "").encode().split(), b" "] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in train for w in tokens[i])
    _, vocab, _, _, likes = hmm.train(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", states=3, rounds=2, settled=-1.0, early=0)
    assert set(vocab.number) <= set(counts) and vocab.number[b" "] == 0
    own = sorted(vocab.number, key=vocab.number.get)[: vocab.symbols]
    classes = {}
    for w, c in counts.items():
        if w not in own:
            classes[hmm.bucket_of(w)] = classes.get(hmm.bucket_of(w), 0.1) + c + 0.1
    name = lambda w: w if w in own else hmm.bucket_of(w)
    prior = {w: counts[w] + 0.1 for w in own} | {b: classes.get(b, 0.1) for b in range(hmm.BUCKETS)}
    whole = sum(prior.values())
    prior = {k: x / whole for k, x in prior.items()}
    first = hmm.first_guess(vocab, 3)
    start, move = list(first.start), [list(r) for r in first.move]
    emit = {k: list(first.emit[vocab.number[k] if isinstance(k, bytes) else vocab.symbols + k]) for k in prior}
    ks = range(3)

    def forward(ts):
        a, out, like = None, [], 0.0
        for t in ts:
            a = [(start[k] if a is None else sum(a[j] * move[j][k] for j in ks)) * emit[name(t)][k] for k in ks]
            c = sum(a)
            a = [x / c for x in a]
            like += math.log10(c)
            out.append((a, c))
        return out, like

    for r in range(2):
        n_start, n_move, n_emit, total = [0.0] * 3, [[0.0] * 3 for _ in ks], {k: [0.0] * 3 for k in prior}, 0.0
        for i in train:
            ts = tokens[i]
            done, like = forward(ts)
            total += like
            b = [1.0] * 3
            for t in range(len(ts) - 1, -1, -1):
                g = [done[t][0][k] * b[k] for k in ks]
                for k in ks:
                    n_emit[name(ts[t])][k] += g[k]
                    n_start[k] += g[k] if t == 0 else 0
                if t:
                    after = [emit[name(ts[t])][k] * b[k] / done[t][1] for k in ks]
                    for j in ks:
                        for k in ks:
                            n_move[j][k] += done[t - 1][0][j] * move[j][k] * after[k]
                    b = [sum(move[j][k] * after[k] for k in ks) for j in ks]
        assert likes[r] == pytest.approx(total / sum(counts.values()), rel=1e-4)
        start = [(x + 0.5) / (sum(n_start) + 1.5) for x in n_start]
        move = [[(x + 0.5) / (sum(row) + 1.5) for x in row] for row in n_move]
        sums = [sum(x[k] for x in n_emit.values()) + hmm.PRIOR for k in ks]
        emit = {w: [(x[k] + hmm.PRIOR * prior[w]) / sums[k] for k in ks] for w, x in n_emit.items()}
    for i, ts in tokens.items():
        share = sum(math.log10((counts[w] + 0.1) / classes.get(hmm.bucket_of(w), 0.1)) for w in ts if w not in own)
        assert got[i]["score"] == pytest.approx(forward(ts)[1] + share, rel=1e-4)


def test_rounds_end_by_the_gain(spark, docs):
    """Early rounds on a share, then rounds over all training rows until one gains under ``SETTLED``; as good as all rounds over all rows."""
    *_, likes = hmm.train(docs, "doc_id", "text")
    *_, plain = hmm.train(docs, "doc_id", "text", early=0)
    for x in (likes, plain):
        assert 2 <= len(x) < hmm.ROUNDS and x[-1] - x[-2] < hmm.SETTLED and all(b - a >= hmm.SETTLED for a, b in zip(x[:-2], x[1:-1], strict=True))
    assert likes[0] > plain[0] and likes[-1] > plain[-1] - 0.05


def test_a_share_is_brought_to_the_corpus():
    """Symbols keep their division over states in the share and get their count in the corpus; one that the share lacks keeps the model's."""
    rng = np.random.default_rng(9)
    model = random_model(rng)
    emitted = np.array([[900.0, 90.0, 10.0], [0.0, 0.0, 0.0], [5.0, 5.0, 490.0], [1.0, 1.0, 1.0]])
    counts = np.array([16000.0, 40.0, 8000.0, 50.0])
    got = hmm.to_corpus(emitted, model, counts)
    assert got.sum(1) == pytest.approx(counts)
    assert got[0] / 16000 == pytest.approx(emitted[0] / 1000, abs=2e-3) and got[2] / 8000 == pytest.approx(emitted[2] / 500, abs=2e-3)
    weight = model.emit[1] * (emitted.sum(0) + 1)
    assert got[1] == pytest.approx(40 * weight / weight.sum())


def random_model(rng, k=3, m=4):
    p = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.1)
    return hmm.Hmm(p(k), p(k, k), p(k, m).T.copy())


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(2)
    model = random_model(rng)
    seqs = [rng.integers(0, 4, n) for n in (1, 4, 6)]
    got = model.log10_likelihood(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert g == pytest.approx(math.log10(total))
    every = [np.array(s) for s in itertools.product(range(4), repeat=3)]
    assert (10 ** model.log10_likelihood(np.concatenate(every), np.full(64, 3))).sum() == pytest.approx(1)


def test_expected_counts_are_those_over_paths():
    rng = np.random.default_rng(4)
    model = random_model(rng)
    seqs = [rng.integers(0, 4, n) for n in (2, 3, 5)]
    start, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s in seqs:
        weights = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            weights[path] = p
        z = sum(weights.values())
        for path, p in weights.items():
            start[path[0]] += p / z
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / z
            for x, a in zip(s, path, strict=True):
                emitted[x, a] += p / z
    (padded, lengths), = hmm._segments(list(seqs))
    got = model.expected(padded, lengths)
    assert got[0] == pytest.approx(start, rel=1e-4) and got[1] == pytest.approx(moves, rel=1e-4) and got[2] == pytest.approx(emitted, rel=1e-4)


def test_lm_odd_rows(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, held_out string")
    got = hmm.hmm_scores(rows).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.hmm_scores(rows.limit(0)).count() == 0
    only = hmm.hmm_scores(rows.filter(F.col("doc_id").isNull())).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in only] == [(0, 0)]


def test_pipeline_stages(spark):
    """Each stage on its own input against brute force; the last packs what is left."""
    from test_near_and_exact import brute
    from test_text_operators import hits

    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], rows.schema)
    docs = rows.unionByName(extra).unionByName(rows.filter("doc_id < 3"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SMALL)
        if k == 4:
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
            break
        assert out.columns == rows.columns
        after = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
        if name == "exact_dedup":
            best = {}
            for i, t in before:
                c = "".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None})
                best[c] = min(best.get(c, (1, 0, "")), (-len(t or ""), i, t or ""))
            assert after == sorted((i, t) for _, i, t in best.values())
        if name == "near_dedup":
            groups = brute(before)
            assert [i for i, _ in after] == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "decontamination":
            assert after == sorted((i, t or "") for i, t in before if not hits(t, items)[1])
        docs = out
    empty = rows.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_expected_counts_of_long_texts():
    """One text of 150 tokens: counts by a plain forward-backward over the whole text."""
    rng = np.random.default_rng(6)
    model = random_model(rng)
    x = rng.integers(0, 4, 150)
    alpha, beta = [model.start * model.emit[x[0]]], [np.ones(3)]
    for s in x[1:]:
        alpha.append((alpha[-1] @ model.move) * model.emit[s])
    for s in x[:0:-1]:
        beta.insert(0, model.move @ (model.emit[s] * beta[0]))
    p = alpha[-1].sum()
    gamma = [a * b / p for a, b in zip(alpha, beta, strict=True)]
    moves = sum(np.outer(alpha[t - 1], model.emit[x[t]] * beta[t]) for t in range(1, 150)) * model.move / p
    for kept in (0, 200_000):
        batches = list(hmm._segments([x, x[:0:-1], x[:3]]))
        got = [sum(y) for y in zip(*(model.expected(*b, kept=kept) if kept == 0 else model.expected(*b) for b in batches), strict=True)]
        assert got[1].sum() == pytest.approx(149 + 148 + 2, rel=1e-4) and got[0].sum() == pytest.approx(3, rel=1e-4) and got[2].sum() == pytest.approx(150 + 149 + 3, rel=1e-4)
    (batch,) = hmm._segments([x])
    for kept in (0, 200_000):
        got = model.expected(*batch, kept=kept)
        near = lambda x: pytest.approx(x, rel=1e-4, abs=1e-5)
        assert got[0] == near(gamma[0]) and got[1] == near(moves) and got[3] == near(math.log(p))
        assert got[2] == near(np.stack([sum((g for g, s in zip(gamma, x, strict=True) if s == m), np.zeros(3)) for m in range(4)]))
