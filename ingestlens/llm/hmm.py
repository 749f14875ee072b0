"""Hidden Markov language model: Baum-Welch over all training texts, exact scaled forward scores.

Three tiers keep every step bounded without dropping a word. The most frequent
words are emission symbols of their own. All others are emitted as one of
``BUCKETS`` classes of word endings times the word's share of its class, so the
model stays a proper distribution over the whole vocabulary and one unknown
word per class. Counts of common words are known inside each task; those of the
long tail are joined by shuffle. Texts are read twice, for counts and for their
symbols; all rounds and the scores read the symbols. Early rounds move the model
near its end on a fixed share of the training rows, then rounds over all of them
go on until one gains next to nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import stored, table
from ingestlens.llm.shingles import words

#: The end of a text as a token; no word has a space.
END = b" "
ADD = 0.1
BUCKETS = 1024
#: At most so many words have their counts in every task (about 20 MB), and of them so many are symbols of their own.
COMMON, SYMBOLS = 131_072, 16_384
STATES = 8
#: The gain in log10 likelihood a token below which a Baum-Welch round is the last, and a limit that stops a training that never settles.
SETTLED, ROUNDS = 0.005, 60
#: Early rounds read the training rows of one in so many parts, by hash of the id; the rounds after them read all.
EARLY = 16
#: Words kept in a task's counter before it is handed on.
COUNTER = 250_000
#: Weight, in tokens, of the corpus distribution in each state's emissions.
PRIOR = 100.0


def bucket_of(word: bytes) -> int:
    """The class of a word that is no symbol: its last three bytes."""
    return zlib.crc32(word[-3:]) % BUCKETS


def held_out(id_col: str):
    """The rows that training never sees; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, bucket, c`` over all rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(map(bucket_of, keys), pa.int32()), pa.array(counts.values(), pa.int64())],
                ["word", "bucket", "n"],
            )
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                counts.update(words(text.as_py()))
                counts[END] += 1
                if len(counts) > COUNTER:
                    yield flush()
        yield flush()

    rows = texts.select("text").mapInArrow(run, "word binary, bucket int, n long")
    return rows.groupBy("word", "bucket").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Common words with their numbers, the first ``SYMBOLS`` of them symbols, and per-word and per-class figures."""

    number: dict[bytes, int]
    counts: np.ndarray
    buckets: np.ndarray
    mass: np.ndarray  # of each class: its words' smoothed counts and one unknown word
    tokens: int
    types: int
    least: int | None  # the step of counts (see _step) from which on a word is common; none: no word is

    @property
    def symbols(self) -> int:
        return min(SYMBOLS, len(self.counts))

    def base_log(self, c):
        return np.log10((c + ADD) / (self.tokens + ADD * (self.types + 1)))

    def symbol_of(self) -> np.ndarray:
        """Each common word's emission symbol."""
        own = np.arange(len(self.counts))
        return np.where(own < self.symbols, own, self.symbols + self.buckets).astype(np.int32)

    def share_log(self) -> np.ndarray:
        """Each common word's share of its symbol; 0 for a symbol of its own."""
        own = np.arange(len(self.counts)) < self.symbols
        return np.where(own, 0.0, np.log10((self.counts + ADD) / self.mass[self.buckets]))

    def prior(self) -> np.ndarray:
        p = self.symbol_counts()
        return p / p.sum()

    def symbol_counts(self) -> np.ndarray:
        """Each symbol's smoothed count over all training rows."""
        return np.concatenate((self.counts[: self.symbols] + ADD, self.mass))


def _step():
    """Eight steps for every doubling of the count."""
    return F.floor(F.log2("c") * 8).cast("int")


def vocabulary(counted: DataFrame) -> Vocabulary:
    """What tasks need of ``counted``; at most ``COMMON`` words and one row per class come to the driver."""
    tokens, types = counted.agg(F.sum("c"), F.count("*")).first()
    by_size = sorted(((r["s"], r["n"]) for r in counted.groupBy(_step().alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for s, n in by_size:
        total += n
        if total >= COMMON:
            break
        least = s
    is_common = (_step() >= least) if least is not None else F.lit(False)
    rows = counted.filter(is_common | (F.col("word") == END)).collect()
    rows.sort(key=lambda r: (bytes(r["word"]) != END, -r["c"], bytes(r["word"])))
    counts = np.array([r["c"] for r in rows], float)
    buckets = np.array([r["bucket"] for r in rows], np.int64)
    mass = np.full(BUCKETS, ADD)
    for r in counted.groupBy("bucket").agg(F.sum(F.col("c") + ADD).alias("m")).collect():
        mass[r["bucket"]] += r["m"]
    own = np.arange(len(rows)) < SYMBOLS
    np.subtract.at(mass, buckets[own], counts[own] + ADD)
    return Vocabulary(
        {bytes(r["word"]): i for i, r in enumerate(rows)}, counts, buckets, np.maximum(mass, ADD), int(tokens or 0), int(types), least
    )


def encode(ws: list[bytes], number: dict[bytes, int], symbol: np.ndarray, first_bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (-1: not common) and symbols of a text's tokens, end included."""
    known = np.array([number.get(w, -1) for w in ws] + [number.get(END, -1)], np.int32)
    out = symbol[known] if len(symbol) else np.zeros(len(known), np.int32)
    for i in np.flatnonzero(known < 0):
        out[i] = first_bucket + bucket_of(ws[i] if i < len(ws) else END)
    return known, out


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state

    def expected(self, symbols: np.ndarray, lengths: np.ndarray, piece: int = 64, kept: int = 200_000):
        """Expected starts, moves and emissions of padded whole sequences (time, sequence), and their log likelihood.

        The recursions run piece by piece. What the forward one found of a piece
        is kept for some ``kept`` tokens in all; further pieces keep the state
        they start from and are run again on the way back.
        """
        order = np.argsort(-lengths, kind="stable")
        symbols, lengths = symbols[:, order], lengths[order]
        steps, n = symbols.shape
        k = len(self.start)
        ones = np.ones(k, np.float32)
        # Single precision within a sequence; every step is scaled, and sums over sequences are double.
        first_state, move, emit = (x.astype(np.float32) for x in (self.start, self.move, self.emit))
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences that have a token at each time

        def forward(first: int, a: np.ndarray | None):
            out = []
            for t in range(first, min(first + piece, steps)):
                e = emit[symbols[t, : active[t]]]
                a = (first_state if a is None else a[: active[t]] @ move) * e
                scale = a @ ones  # faster than a sum over few columns
                a = a / scale[:, None]
                out.append((a, e, scale))
            return out

        entries, stored_pieces, tokens, like, a = {}, {}, 0, 0.0, None
        for first in range(0, steps, piece):
            entries[first] = a
            done = forward(first, a)
            a = done[-1][0]
            like += sum(float(np.log(scale).sum(dtype=float)) for _, _, scale in done)
            tokens += int(active[first : first + piece].sum())
            if tokens <= kept:
                stored_pieces[first] = done
        start, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((len(self.emit), k))
        beta = np.ones((0, k), np.float32)
        for first in reversed(entries):
            done = stored_pieces.pop(first, None) or forward(first, entries[first])
            gammas = []
            for t in range(first + len(done) - 1, first - 1, -1):
                alpha, e, scale = done[t - first]
                beta = np.concatenate((beta, np.ones((len(alpha) - len(beta), k), np.float32)))  # a sequence's last token
                if not gammas:  # alpha * beta sums to one but for rounding, which is taken out once a piece
                    beta = beta / (alpha * beta).sum(1, keepdims=True)
                gammas.append(alpha * beta)
                if t:
                    before = done[t - first - 1][0] if t > first else entries[first]
                    ahead = e * beta / scale[:, None]
                    moves += before[: len(ahead)].T @ ahead
                    beta = ahead @ move.T
            flat = np.concatenate([symbols[t, : active[t]] for t in range(first + len(done) - 1, first - 1, -1)])
            g = np.concatenate(gammas)
            for s in range(k):
                emitted[:, s] += np.bincount(flat, g[:, s], len(self.emit))
            if not first:
                start = gammas[-1].sum(0, dtype=float)
        return start, moves * self.move, emitted, like

    @staticmethod
    def fitted(start, moves, emitted, prior: np.ndarray) -> Hmm:
        k = len(start)
        move = moves + 0.5
        emit = emitted + PRIOR * prior[:, None]
        return Hmm((start + 0.5) / (start.sum() + 0.5 * k), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10_likelihood(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence in ``flat`` (one after the other), by the scaled forward recursion."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        out = np.zeros(len(lengths))
        active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        ones = np.ones(len(self.start))
        alpha = np.broadcast_to(self.start, (len(lengths), len(self.start)))
        for t, n in enumerate(active):
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ self.move) * self.emit[flat[starts[:n] + t]]
            c = alpha @ ones
            alpha /= c[:, None]
            out[:n] += np.log10(c)
        back = np.empty_like(out)
        back[order] = out
        return back


def _segments(streams: list[np.ndarray], at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole symbol streams for training, padded, time first; those of one batch are at most four times as long as its shortest, or short."""
    left = sorted(streams, key=len)
    while left:
        most = max(64, 4 * len(left[0]))
        n = next((i for i, s in enumerate(left[:at_once]) if len(s) > most), min(at_once, len(left)))
        part, left = left[:n], left[n:]
        lengths = np.array([len(s) for s in part])
        padded = np.zeros((int(lengths.max()), len(part)), np.int32)
        for j, s in enumerate(part):
            padded[: len(s), j] = s
        yield padded, lengths


def first_guess(vocab: Vocabulary, states: int, stay: float = 0.9, width: float = 1.0, seed: int = 7) -> Hmm:
    """Where Baum-Welch starts: counts over all training rows, tilted by the words' letters, and sticky states.

    A state's emissions are the corpus distribution times exp(width * g), where
    g is a fixed random projection of the pairs of letters in the word. Words
    written alike lean to the same state, which tells states apart from the
    first round on; no row is looked at.
    """
    rng = np.random.default_rng(seed)
    table_, prior = rng.normal(size=(4096, states)), vocab.prior()
    tilt = np.zeros((len(prior), states))
    for word, i in vocab.number.items():
        if i < vocab.symbols:
            w = b" " + word + b" "
            pairs = [zlib.crc32(w[j : j + 2]) % len(table_) for j in range(len(w) - 1)]
            tilt[i] = table_[pairs].sum(0) / len(pairs) ** 0.5
    emit = prior[:, None] * np.exp(width * tilt)
    return Hmm(np.full(states, 1 / states), np.full((states, states), (1 - stay) / states) + stay * np.eye(states), emit / emit.sum(0))


def encoded(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Every row's tokens as symbols (two bytes each), its figures over common words, and its rare words with their counts."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocab.number, vocab.symbol_of(), vocab.symbols, vocab.base_log(vocab.counts), vocab.share_log()))
    names = ["row", "id", "train", "symbols", "n_tokens", "n_known", "base", "share", "words", "buckets", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, symbol, first_bucket, base_log, share_log = shared.value
        for batch in batches:
            flat, lengths, known, base, share, tails = [], [], [], [], [], []
            for text in batch.column("text"):
                ws = words(text.as_py())
                k, s = encode(ws, number, symbol, first_bucket)
                some = k[k >= 0]
                flat.append(s.astype("<u2").tobytes())
                lengths.append(len(s))
                known.append(len(some))
                base.append(float(base_log[some].sum()))
                share.append(float(share_log[some].sum()))
                tails.append(Counter(ws[i] if i < len(ws) else END for i in np.flatnonzero(k < 0)))
            ends = np.cumsum([0, *map(len, tails)]).astype(np.int32)
            rare = [w for t in tails for w in t]
            lists = [
                pa.array(rare, pa.binary()),
                pa.array([bucket_of(w) for w in rare], pa.int32()),
                pa.array([n for t in tails for n in t.values()], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("train"), pa.array(flat, pa.binary()), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(share, pa.float64()), *(pa.ListArray.from_arrays(ends, x) for x in lists)],
                names,
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (~held_out(id_col)).alias("train"), F.col(text_col).alias("text"))
    schema = f"row long, id {id_type}, train boolean, symbols binary, n_tokens long, n_known long, base double, share double, words array<binary>, buckets array<int>, times array<int>"
    return stored(rows.mapInArrow(run, schema), "encoded-texts")


def to_corpus(emitted: np.ndarray, model: Hmm, counts: np.ndarray) -> np.ndarray:
    """Expected emissions of a share of the texts, brought to each symbol's count over all of them.

    The share says how a symbol divides over the states, the corpus how often it
    is. ``model`` has the weight of one token in that, so a symbol that the share
    lacks divides as before.
    """
    before = model.emit * (emitted.sum(0) + 1)
    before /= before.sum(1, keepdims=True)
    return (emitted + before) * (counts / (emitted.sum(1) + 1))[:, None]


def baum_welch(symbols: DataFrame, vocab: Vocabulary, model: Hmm, whole: bool = True) -> tuple[Hmm, float]:
    """One Baum-Welch round over all texts of ``symbols``, and the log10 likelihood a token before it.

    Every partition hands on its expected counts, which Spark adds up. Without
    ``whole`` the texts are a share of those that ``vocab`` counts.
    """
    sc = symbols.sparkSession.sparkContext
    shared = sc.broadcast(model)
    states, size = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0]
        for batch in batches:
            column, at = batch.column("symbols"), 0
            while at < len(column):  # some two million tokens at a time, so that few long texts share their steps with many
                streams, tokens = [], 0
                while at < len(column) and tokens < 2_000_000:
                    streams.append(np.frombuffer(column[at].as_py(), "<u2"))
                    tokens += len(streams[-1])
                    at += 1
                for padded, lengths in _segments(streams):
                    total = [t + x for t, x in zip(total, model.expected(padded, lengths), strict=True)]
        rows = np.concatenate((total[2], total[1], total[0][None], np.full((1, states), total[3])))
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), *(pa.array(rows[some, s]) for s in range(states))], ["at", *(f"n{s}" for s in range(states))]
        )

    schema = "at long, " + ", ".join(f"n{s} double" for s in range(states))
    sums = symbols.select("symbols").mapInArrow(run, schema).groupBy("at").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(states)])
    rows = np.zeros((size + states + 2, states))
    for r in sums.collect():  # a row per symbol and state, whatever the corpus
        rows[r["at"]] = r[1:]
    shared.unpersist()
    emitted = rows[:size]
    like = rows[-1, 0] / max(1, emitted.sum()) / np.log(10)
    return Hmm.fitted(rows[-2], rows[size : size + states], emitted if whole else to_corpus(emitted, model, vocab.symbol_counts()), vocab.prior()), like


def _until_settled(symbols: DataFrame, vocab: Vocabulary, model: Hmm, rounds: int, settled: float, whole: bool) -> tuple[Hmm, list[float]]:
    """Rounds until one gains less than ``settled``; the likelihoods are those before each."""
    likes: list[float] = []
    while len(likes) < rounds and (len(likes) < 2 or likes[-1] - likes[-2] >= settled):
        model, like = baum_welch(symbols, vocab, model, whole)
        likes.append(like)
    return model, likes


def train(docs: DataFrame, id_col: str, text_col: str, states: int = STATES, rounds: int = ROUNDS, settled: float = SETTLED, early: int = EARLY):
    """``counted, vocabulary, encoded rows, model, likelihoods`` from the rows that are not held out.

    Counts cover all of them, and their whole texts. Rounds over one in
    ``early`` of them (0: none) start from the first guess and end when one
    gains less than a quarter of ``settled`` in log10 likelihood a token; rounds
    over all of them follow and end when one gains less than ``settled``.
    ``rounds`` bounds each. The likelihoods are those of the rounds over all rows.
    """
    counted = stored(word_counts(docs.filter(~held_out(id_col)).select(F.col(text_col).alias("text"))), "word-counts")
    vocab = vocabulary(counted)
    coded = encoded(docs, vocab, id_col, text_col)
    learned, model = coded.filter("train"), first_guess(vocab, states)
    if early:
        some = stored(learned.filter(F.pmod(F.xxhash64("id"), F.lit(early)) == 0).select("symbols"), "early-texts")
        model, _ = _until_settled(some, vocab, model, rounds, settled / 4, False)
    model, likes = _until_settled(learned, vocab, model, rounds, settled, True)
    return counted, vocab, coded, model, likes


def score_texts(coded: DataFrame, counted: DataFrame, vocab: Vocabulary, model: Hmm) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` for every row of ``coded``."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), "<u2")
            like = model.log10_likelihood(flat, np.asarray(batch.column("n_tokens")))
            yield batch.drop_columns(["symbols", "share"]).append_column("score", pa.array(like + np.asarray(batch.column("share"))))

    columns = ["row", "id", "symbols", "n_tokens", "n_known", "base", "share"]
    id_type = coded.schema["id"].dataType.simpleString()
    local = coded.select(*columns).mapInArrow(run, f"row long, id {id_type}, n_tokens long, n_known long, base double, score double")
    # The tail: each text's rare words meet their counts. No word here is frequent in training; one that is
    # frequent in held-out rows alone is left to adaptive execution, which cuts its rows over tasks.
    rare = coded.select("row", F.explode(F.arrays_zip("words", "buckets", "times")).alias("t")).select(
        "row", F.col("t.words").alias("word"), F.col("t.buckets").alias("bucket"), F.col("t.times").alias("times")
    )
    c = F.coalesce("c", F.lit(0))
    mass = F.element_at(F.lit([float(m) for m in vocab.mass]), F.col("bucket") + 1)
    whole = vocab.tokens + ADD * (vocab.types + 1)
    uncommon = counted if vocab.least is None else counted.filter(_step() < vocab.least)
    tail = (
        rare.join(uncommon.select("word", "c"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((c + ADD) / F.lit(whole))).alias("more_base"),
            F.sum(F.col("times") * F.log10((c + ADD) / mass)).alias("more_score"),
        )
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias
    return local.join(tail, "row", "left").select(
        "id",
        "n_tokens",
        plus("n_known", "more_known")("n_known"),
        plus("base", "more_base")("base_score"),
        plus("score", "more_score")("score"),
    )


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32(id as text) mod 10 is 0 are held out of training. Null and
    empty texts are one end token. Repeated rows are scored each. With no
    training rows every word is unknown; an empty table gives an empty result.
    """
    counted, vocab, coded, model, _ = train(docs, id_col, text_col, **options)
    scored = score_texts(coded, counted, vocab, model).withColumnRenamed("id", id_col)
    return scored.select(
        id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op7_hmm_lm(spark, sf_dir):
    return hmm_scores(table(spark, sf_dir, "documents"))
