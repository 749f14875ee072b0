"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its words, pairs
of words and word endings (hashed) and from figures of its surface, gated
attention weights (learned from document labels alone) say how much each
counts, and the weighted representation is scored. The bags stay in Spark: every
round of the training sums the gradients of its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestlens.llm import shingles as S
from ingestlens.llm.common import stored, table

#: Words of a passage.
PASSAGE = 64
#: The classifier is fitted on at most this many labelled rows, the first in order of a hash of their id, and on all their passages.
SAMPLE = 4000
#: Rows of the embedding that words, pairs and endings are hashed to.
GRAMS = 8192
#: Passages encoded at a time, and those of one stored row of a bag.
AT_ONCE, PIECE = 4000, 1000
#: Tasks of a round of the training at most; each hands one set of gradients (0.6 MB) to the driver.
TASKS = 16

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" ", b".", b",;:", b"!?", b"|", b"'\"()-", b"@/\\_=<>{}[]", b"#$%&*+^~`"]
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _i, _bytes in enumerate(_KINDS):
    _KIND_OF[list(_bytes)] = _i
FEATURES = len(_KINDS) + 1 + 10


@dataclass
class Passages:
    """Passages of one or more texts: figures of the surface, hashed grams one passage after another, and how many grams each has."""

    x: np.ndarray
    grams: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def join(parts: list[Passages]) -> Passages:
        return Passages(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("x", "grams", "sizes")))

    def __len__(self) -> int:
        return len(self.x)

    def cut(self, size: int) -> Iterator[tuple[slice, slice]]:
        """Runs of at most ``size`` passages, and where their grams are."""
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        for i in range(0, len(self.sizes), size):
            j = min(i + size, len(self.sizes))
            yield slice(i, j), slice(int(ends[i]), int(ends[j]))


def passages(text: str | None) -> Passages:
    """All passages of the whole text; a text without words is one passage of zeros and no grams."""
    raw = text.encode("utf-8", "surrogatepass").split() if text else []
    if not raw:
        return Passages(np.zeros((1, FEATURES), np.float32), np.empty(0, np.int32), np.zeros(1, np.int64))
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.flatnonzero(joined == 32)
    sizes = np.diff(np.concatenate(([-1], ends))) - 1
    n = -(-len(raw) // PASSAGE)
    of_word = np.arange(len(raw)) // PASSAGE
    of_byte = np.repeat(of_word, sizes + 1)
    kinds = np.bincount(of_byte * (len(_KINDS) + 1) + _KIND_OF[joined], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)
    mean = lambda x: np.bincount(of_word, x, n) / n_words
    n_words = np.bincount(of_word, minlength=n).astype(float)
    hashes = S.word_hashes(joined, ends)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    new = np.zeros(len(raw))
    new[first] = 1
    here = np.unique(of_word * (len(first) + 1) + number) // (len(first) + 1)
    pairs = S.mix(hashes[1:] * np.uint64(3) + hashes[:-1])
    repeated = np.zeros(len(raw))
    if len(pairs):
        _, at, times = np.unique(pairs, return_inverse=True, return_counts=True)
        repeated[1:] = times[at] > 1
    adjacent = np.concatenate(([0.0], hashes[1:] == hashes[:-1]))
    starts = joined[np.concatenate(([0], ends[:-1] + 1))]
    lasts = _KIND_OF[joined[ends - 1]]
    length = mean(sizes)
    out = np.column_stack(
        (
            kinds / kinds.sum(1, keepdims=True),
            np.log1p(length),
            np.sqrt(np.maximum(mean(sizes.astype(float) ** 2) - length**2, 0)) / (1 + length),
            mean(sizes <= 3),
            mean((starts >= 65) & (starts <= 90)),
            mean((lasts >= 5) & (lasts <= 7)),
            mean(lasts >= 8),
            np.bincount(here, minlength=n) / n_words,
            mean(new),
            mean(adjacent) + mean(repeated),
            np.log1p(n_words) / 4,
        )
    )
    # A passage's words, pairs of words that both lie in it, and last three letters, in this order of each word.
    endings = np.zeros(len(raw), np.uint64)
    for back in (1, 2, 3):
        endings = endings * np.uint64(257) + np.where(sizes >= back, joined[ends - back], 32).astype(np.uint64)
    pair = np.concatenate((np.zeros(1, np.uint64), pairs))
    every = np.stack((S.mix(hashes), S.mix(pair + np.uint64(1)), S.mix(endings + np.uint64(2))), 1)
    there = np.ones(every.shape, bool)
    there[::PASSAGE, 1] = False
    grams = (every[there] % np.uint64(GRAMS)).astype(np.int32)
    return Passages(out.astype(np.float32), grams, 3 * n_words.astype(np.int64) - 1)


@dataclass
class GatedAttention:
    """Encoder, gated attention and output weights; ``mean`` and ``spread`` standardise the features."""

    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, bags: Passages, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``bags``: all passages, one bag after another; ``starts``: where each bag begins."""
        p = self.p
        x = np.clip((bags.x - self.mean) / self.spread, -8, 8)
        embedded = np.zeros((len(x), p["E"].shape[1]), p["E"].dtype)
        for at, grams in bags.cut(AT_ONCE):
            known = np.flatnonzero(bags.sizes[at])
            sizes = bags.sizes[at][known]
            if len(known):
                embedded[at.start + known] = np.add.reduceat(p["E"][bags.grams[grams]], np.cumsum(sizes) - sizes) / sizes[:, None]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["W"] + embedded + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "bags": bags, "bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "score": 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))}

    def gradients(self, f: dict[str, np.ndarray], starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed log loss of the bags."""
        p, bag, a, h = self.p, f["bag"], f["a"], f["h"]
        d = f["score"] - y
        dz = d[:, None] * p["o"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dvu = de[:, None] * p["w"]
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        bags, embedding = f["bags"], np.zeros(p["E"].shape)
        per_gram = (dh / np.maximum(bags.sizes, 1)[:, None]).astype(p["E"].dtype)
        for at, grams in bags.cut(AT_ONCE):
            each, where = np.repeat(per_gram[at], bags.sizes[at], 0), bags.grams[grams]
            for k in range(each.shape[1]):
                embedding[:, k] += np.bincount(where, each[:, k], GRAMS)
        return {"E": embedding, "W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (f["v"] * f["u"]).T @ de, "o": f["z"].T @ d, "c": d.sum()}


def first_model(mean: np.ndarray, spread: np.ndarray, share: float, hidden: int = 16, gate: int = 8, seed: int = 5) -> GatedAttention:
    """Where the training starts; what was never seen counts for nothing, and without output weights the score is ``share``."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "o": (hidden,)}
    p = {k: rng.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()}
    return GatedAttention(mean, spread, p | {"b": np.zeros(hidden), "E": np.zeros((GRAMS, hidden), np.float32), "c": np.float64(np.log(share / (1 - share)))})


def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Passages, np.ndarray]]:
    """Labels, passages and starts of whole bags, some ``AT_ONCE`` passages at a time, from rows in order of (id, piece)."""
    ys, parts, lengths = [], [], []
    for batch in batches:
        for i in range(batch.num_rows):
            at = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if at["piece"] == 0:
                if sum(lengths) >= AT_ONCE:
                    yield _whole(ys, parts, lengths)
                    ys, parts, lengths = [], [], []
                ys.append(at["y"])
                lengths.append(0)
            parts.append(Passages(np.frombuffer(at["x"], np.float32).reshape(-1, FEATURES), np.frombuffer(at["grams"], np.int32), np.frombuffer(at["sizes"], np.int64)))
            lengths[-1] += len(parts[-1])
    if ys:
        yield _whole(ys, parts, lengths)


def _whole(ys: list[float], parts: list[Passages], lengths: list[int]) -> tuple[np.ndarray, Passages, np.ndarray]:
    return np.array(ys), Passages.join(parts), np.cumsum(lengths) - lengths


def moments(bags: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the surface figures over all passages of ``bags``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES + 1))
        for batch in batches:
            for raw in batch.column("x"):
                x = np.frombuffer(raw.as_py(), np.float32).reshape(-1, FEATURES).astype(float)
                sums += np.stack((np.append(x.sum(0), len(x)), np.append((x**2).sum(0), len(x))))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["task", "sums"])

    got = sorted(bags.select("x").mapInArrow(run, "task int, sums binary").collect())
    sums = sum((np.frombuffer(r["sums"]).reshape(2, -1) for r in got), np.zeros((2, FEATURES + 1)))
    n = max(1.0, sums[0, -1])
    mean = sums[0, :-1] / n
    return mean, np.sqrt(np.maximum(sums[1, :-1] / n - mean**2, 0)) + 0.02


def gradients(bags: DataFrame, model: GatedAttention) -> tuple[dict[str, np.ndarray], float]:
    """Summed gradients of the log loss over all ``bags``, and the loss; one row for each task comes to the driver."""
    shared = bags.sparkSession.sparkContext.broadcast(model)
    names = sorted(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, loss = shared.value, 0.0
        total = {k: np.zeros(np.shape(v)) for k, v in model.p.items()}
        for y, passages_, starts in bags_of(batches):
            f = model.forward(passages_, starts)
            score = np.clip(f["score"], 1e-12, 1 - 1e-12)
            loss -= float((y * np.log(score) + (1 - y) * np.log(1 - score)).sum())
            for k, g in model.gradients(f, starts, y).items():
                total[k] = total[k] + g
        flat = np.concatenate([np.ravel(total[k]) for k in names]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([loss]), pa.array([flat.tobytes()], pa.binary())], ["task", "loss", "flat"])

    got = sorted(bags.mapInArrow(run, "task int, loss double, flat binary").collect(), key=lambda r: r["task"])
    shared.unpersist()
    flat = sum((np.frombuffer(r["flat"], np.float32).astype(float) for r in got), np.zeros(sum(np.size(v) for v in model.p.values())))
    out, at = {}, 0
    for k in names:
        size = np.size(model.p[k])
        out[k] = flat[at : at + size].reshape(np.shape(model.p[k]))
        at += size
    return out, sum(r["loss"] for r in got)


def fit(bags: DataFrame, rounds: int = 24, rate: float = 0.05, decay: float = 1e-4) -> GatedAttention:
    """Adam on the mean log loss of all bags (id, y, piece, x, grams, sizes), a round over all of them a step.

    Without bags of both labels every score is the share of ones (0.5 for none).
    """
    n, ones, least, most = bags.filter("piece = 0").agg(F.count("*"), F.sum("y"), F.min("y"), F.max("y")).first()
    model = first_model(*moments(bags), ((ones or 0.0) + 0.5) / (n + 1))
    if least == most:
        model.p["o"] = np.zeros_like(model.p["o"])
        return model
    # A bag's pieces lie in one task, in order; kept on disk, and found again from the stored bags where an executor is lost.
    placed = bags.repartition("id").sortWithinPartitions("id", "piece").coalesce(TASKS).persist(StorageLevel.DISK_ONLY)
    m, s = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}
    for step in range(1, rounds + 1):
        sums, _ = gradients(placed, model)
        now = rate * (1 - (step - 1) / rounds)
        for k, grad in sums.items():
            grad = grad / n + decay * model.p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad**2
            moved = model.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            model.p[k] = moved.astype(model.p[k].dtype)
    placed.unpersist()
    return model


def held_out(id_col: str):
    """Rows whose labels are never learned from; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> GatedAttention:
    """The classifier, fitted on at most ``sample`` labelled rows that are not held out, and on all their passages.

    The passages are written to the shared folder, a thousand to a row, and
    neither the driver nor a task ever holds more of them than some
    ``AT_ONCE`` or one bag.

    An id with several labels counts with their mean; of several texts of one
    id the one with the least hash is learned from. Labels other than 0 and 1
    count for nothing.
    """
    y = F.avg(F.col(label_col).cast("double")).alias("y")
    usable = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(y)
    some = usable.orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bag = passages(batch.column("text")[i].as_py())
                for piece, (at, grams) in enumerate(bag.cut(PIECE)):
                    columns = [pa.array([x.tobytes()], pa.binary()) for x in (bag.x[at], bag.grams[grams], bag.sizes[at])]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), batch.column("y").slice(i, 1), pa.array([piece], pa.int32()), *columns], ["id", "y", "piece", "x", "grams", "sizes"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # ``some`` has at most ``sample`` rows, whatever the tables hold.
    rows = texts.join(F.broadcast(some), "id").groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return fit(stored(rows.select("id", "y", "t.text").mapInArrow(run, f"id {id_type}, y double, piece int, x binary, grams binary, sizes binary"), "bags"))


def quality_scores(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score, predicted, n_passages, top_passage, top_weight``.

    The whole text counts, of any length: its passages are encoded
    ``AT_ONCE`` at a time. Null and empty texts are one empty passage and get
    its score. An empty table gives an empty result. ``top_passage`` is the number of the passage with the largest
    attention weight, ``top_weight`` that weight. Columns with the result's
    names are replaced.
    """
    new = "score double, predicted int, n_passages long, top_passage long, top_weight double"
    base = docs.drop(*[c.split()[0] for c in new.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, at = batch.column(text_col), base_names, 0
            while at < batch.num_rows:
                bags: list[Passages] = []
                n = 0
                while at + len(bags) < batch.num_rows and n < AT_ONCE:
                    bags.append(passages(texts[at + len(bags)].as_py()))
                    n += len(bags[-1])
                lengths = np.array([len(b) for b in bags])
                starts = np.cumsum(lengths) - lengths
                f = model.forward(Passages.join(bags), starts)
                tops = np.array([int(f["a"][s : s + k].argmax()) for s, k in zip(starts, lengths, strict=True)])
                score = np.clip(f["score"], 0, 1)
                arrays = [c.slice(at, len(bags)) for c in batch.columns]
                arrays += [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(lengths, pa.int64()), pa.array(tops, pa.int64()), pa.array(f["a"][starts + tops])]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "score", "predicted", "n_passages", "top_passage", "top_weight"])
                at += len(bags)

    base_names = base.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), new])
    return base.mapInArrow(run, schema)


def op5_mil_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_passages", "top_passage")
