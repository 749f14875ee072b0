"""Best-fit packing by patterns of few documents whose repeat counts a non-negative least-squares fit gives."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ingestlens.llm.common import stored, table

END_ID = 2
SEQUENCE = 1024
#: Characters up to here have had their classes in every Unicode version that the tokenizer libraries know.
SETTLED = "԰"


@lru_cache(maxsize=2)
def _encoder(json_path: str | None, ranks_path: str | None):
    """text -> uint32 ids of the byte-level BPE, equal to the ``tokenizers`` file's.

    The same vocabulary as ranks is several times faster and gives the same ids
    on ordinary text; a text that spells a special token or has characters whose
    class newer Unicode versions may have changed goes to ``tokenizers`` itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|" not in text and (text.isascii() or max(text) < SETTLED):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = SEQUENCE,
    with_ids: bool = False,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian bytes): each document's ids, then id 2.

    A document of at most ``max_len`` ids is one piece; a longer one is cut into
    pieces of ``max_len`` of which the first takes the remainder.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, ranks_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = batch.column("text")
            for i in range(batch.num_rows):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(END_ID)).astype("<u4")
                cuts = [0, *range(len(ids) % max_len or max_len, len(ids), max_len), len(ids)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    piece = ids[a:b].tobytes()
                    for column, value in zip(out, (i, p, a, b - a, zlib.crc32(piece), piece if with_ids else None), strict=True):
                        column.append(value)
            ids_of = batch.column("id").take(pa.array(out[0], pa.int32()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids_of, *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.BinaryType()))]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return rows if with_ids else rows.drop("ids")


def few_document_patterns(max_len: int, step: int = 16) -> list[tuple[int, ...]]:
    """Patterns that fill a sequence exactly: one piece, all pairs, and triples whose larger two lie on a grid."""
    pairs = [(a, max_len - a) for a in range(max_len - 1, (max_len - 1) // 2, -1)]
    triples = [
        (a, b, max_len - a - b)
        for a in range(step, max_len, step)
        for b in range(step, a + 1, step)
        if 0 < max_len - a - b <= b
    ]
    return [(max_len,), *pairs, *triples]


def nnls_counts(histogram: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, A[l, p] = how often pattern p has length l.

    Accelerated projected gradient; A has a few entries a column and is applied
    by scatter and gather.
    """
    at = np.concatenate([np.full(len(p), i) for i, p in enumerate(patterns)])
    length = np.concatenate([np.array(p) for p in patterns])
    size = len(histogram)
    forward = lambda x: np.bincount(length, x[at], size)
    back = lambda r: np.bincount(at, r[length], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue of A'A gives the step
        v = back(forward(v))
        v /= (norm := np.linalg.norm(v))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - histogram) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def pack_histogram(histogram: np.ndarray, max_len: int) -> list[tuple[list[tuple[int, int]], int]]:
    """A plan for ``histogram[l]`` pieces of every length l: (``[(length, how many)], repeats``) patterns.

    Fitted counts are rounded down to what the histogram still holds, the
    largest first. What is left is packed best fit: the longest length left,
    then again and again the longest that fits, and this pattern as often as its
    lengths last, which empties at least one length; so the plan has at most
    ``max_len`` patterns besides the fitted ones, however many pieces there are.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[list[tuple[int, int]], int]] = []

    def use(pattern: dict[int, int], most: int) -> None:
        times = min(most, *(int(left[n]) // k for n, k in pattern.items()))
        if times > 0:
            for n, k in pattern.items():
                left[n] -= k * times
            plan.append((sorted(pattern.items(), reverse=True), times))

    patterns = few_document_patterns(max_len)
    counts = nnls_counts(left.astype(float), patterns)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 1:
            break
        use({n: patterns[i].count(n) for n in set(patterns[i])}, int(counts[i]))
    while left.any():
        pattern: dict[int, int] = {}
        room, longest = max_len, max_len
        while room:
            fits = np.flatnonzero(left[: min(room, longest) + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = min(room // n, int(left[n]))
            pattern[n], room, longest = k, room - k * n, n - 1
        use(pattern, int(left.sum()))
    return plan


def pack_pieces(pieces: DataFrame, max_len: int = SEQUENCE, rows_per_task: int = 500_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; only the histogram of lengths comes to the driver.

    Pieces of one length are interchangeable, so each takes a rank within its
    length and the plan says which sequence and offset a rank has. A length is
    ranked in parts of about ``rows_per_task`` rows whose exact counts give each
    its first rank; one frequent length is many tasks.
    """
    spark = pieces.sparkSession
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(max_len + 1, np.int64)
    for n, k in counted.items():
        histogram[n] = k
    slots, used, first = [], np.zeros(max_len + 1, np.int64), 0
    for pattern, times in pack_histogram(histogram, max_len):
        offset = 0
        for n, k in pattern:
            slots.append((n, int(used[n]), int(used[n]) + k * times, first, offset, k))
            used[n] += k * times
            offset += n * k
        first += times
    # Bounded by the plan: at most 44 distinct lengths fit in a pattern of 1024.
    slot = spark.createDataFrame(slots, "length long, low long, high long, first long, at long, each long")

    parts = max(1, -(-int(histogram.max(initial=0)) // rows_per_task))
    placed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = sizes.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("ahead"))
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(ahead, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    inside = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(slot), "length")
        .filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div each"))
        .withColumn("offset", F.col("at") + F.pmod(inside, F.col("each")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Every document's token pieces with their sequence and offset.

    A null text counts as empty: one piece with only the end id. Repeated rows
    are packed each. Sequences are numbered from 0 and filled from offset 0
    without gaps. An empty table gives an empty result.
    """
    return pack_pieces(stored(token_pieces(docs, id_col, text_col, max_len, with_ids), "pieces"), max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (array of int) of pieces packed ``with_ids``; a sequence is one bounded group."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in row), "<u4").tolist() for row in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return parts.mapInArrow(run, "sequence_id long, ids array<int>")


def op10_pattern_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
