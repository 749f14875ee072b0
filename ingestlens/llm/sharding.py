"""Sharding by histogram sort: exact byte counts below probes, refined until the splitters meet tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ingestlens.llm.common import crc32_long, stored, table

#: Keys are below 2**63: 32 bits of the text's CRC, then 31 bits of the id's hash.
KEY_END = 1 << 63
ID_BITS = 31
#: Parts over which the rows of one key are dealt where they are too many for a task.
TIES = 4096


def sort_key(id_col: str, text_crc: Column) -> Column:
    """Equal texts get adjacent keys; within them the id's hash spreads a hot text."""
    return F.shiftleft(text_crc, ID_BITS).bitwiseOR(F.xxhash64(id_col).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def _tree(key: Column, bounds: list[int], first: int = 0) -> Column:
    """How many of the sorted ``bounds`` are <= key, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), _tree(key, bounds[:mid], first)).otherwise(
        _tree(key, bounds[mid + 1 :], first + mid + 1)
    )


def _histogram(keyed: DataFrame, open_: list[tuple[int, int]], probes: int) -> list[tuple[int, int, int]]:
    """Exact bytes in every stretch of the key space, as sorted (low, high, bytes).

    The ``open_`` stretches are cut by ``probes`` even probes, what lies between
    them is one stretch each: at most ``(probes + 1) * len(open_) + 1`` rows come
    to the driver, whatever the table's size.
    """
    edges = sorted({0, *(x for stretch in open_ for x in stretch)} - {KEY_END})
    ends = [*edges[1:], KEY_END]
    cut = {lo for lo, _ in open_}
    steps = [-(-(hi - lo) // probes) if lo in cut else KEY_END - 1 for lo, hi in zip(edges, ends, strict=True)]
    at = F.col("place") + 1
    rows = (
        keyed.select("size", "key", _tree(F.col("key"), edges[1:]).alias("place"))
        .select(
            "size",
            "place",
            (F.col("key") - F.element_at(F.array(*map(F.lit, edges)), at)).alias("past"),
            F.element_at(F.array(*map(F.lit, steps)), at).alias("step"),
        )
        .groupBy("place", F.expr("past div step").alias("probe"))
        .agg(F.sum("size").alias("bytes"))
        .collect()
    )
    return sorted(
        (lo := edges[r["place"]] + r["probe"] * steps[r["place"]], min(lo + steps[r["place"]], ends[r["place"]]), r["bytes"])
        for r in rows
    )


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 64) -> list[int]:
    """``shards - 1`` keys so that the bytes below the i-th are i/shards of all, within ``tolerance`` of a shard.

    Each round counts, in one aggregation over ``keyed`` (key, size), the exact
    bytes between all probes at once and narrows every open splitter to one
    probe interval, 1/``probes`` of the last. A splitter is settled when it is
    near enough or its interval holds a single key.
    """
    stretches = _histogram(keyed, [(0, KEY_END)], shards * probes)
    total = sum(size for _, _, size in stretches)
    goals = dict(enumerate(i * total / shards for i in range(1, shards)))
    found: dict[int, int] = {}
    while total:
        open_, under, at = {}, 0, 0
        for g, goal in goals.items():
            while under + stretches[at][2] < goal:
                under += stretches[at][2]
                at += 1
            low, high, size = stretches[at]
            if min(goal - under, under + size - goal) <= tolerance * total / shards or high - low <= 1:
                found[g] = low if goal - under <= under + size - goal else high
            else:
                open_[g] = (low, high)
        if not open_:
            break
        goals = {g: goals[g] for g in open_}
        stretches = _histogram(keyed, sorted(set(open_.values())), probes)
    return [min(found[g], KEY_END - 1) for g in sorted(found)]


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` plus ``size, text_crc32, __key, __tie``, the only columns that the search for splitters reads."""
    base = docs.drop("size", "text_crc32", "shard", "slot")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    return (
        base.withColumns({"size": size, "text_crc32": crc32_long(F.col(text_col))})
        .withColumn("__key", sort_key(id_col, F.col("text_crc32")))
        .withColumn("__tie", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(TIES)))
    )


def _ranges(keyed: DataFrame, splitters: list[int], rows_per_task: int) -> DataFrame:
    """``keyed`` plus ``shard`` and ``__from, __part``: a stretch of keys of some ``rows_per_task`` rows at most.

    Stretches are even ones of the key space. One with too many rows, because a
    text is frequent, is cut again by the bits that hold the id's hash; where a
    single key has too many (repeated rows), these are dealt by ``__tie``, which
    costs no order. A list of such stretches has at most a row per
    ``rows_per_task`` rows of the table, so it is broadcast.
    """
    total = keyed.agg(F.count("*")).first()[0]
    bits = min(30, max(0, (2 * total // rows_per_task).bit_length()))
    key = F.col("__key")
    cut = lambda n: F.shiftleft(F.shiftright(key, n), n)

    def busy(rows: DataFrame, flag: str) -> DataFrame:
        crowded = rows.groupBy("shard", "__from").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_task)
        return rows.join(F.broadcast(crowded.select("shard", "__from", F.lit(True).alias(flag))), ["shard", "__from"], "left")

    even = busy(keyed.withColumn("shard", _tree(key, splitters)).withColumn("__from", cut(63 - bits)), "__busy")
    fine = even.withColumn("__from", F.when(F.col("__busy"), cut(ID_BITS - 16)).otherwise(F.col("__from")))
    fine = busy(fine, "__full").withColumn("__from", F.when(F.col("__full"), key).otherwise(F.col("__from")))
    one = busy(fine.drop("__busy", "__full"), "__one")
    return one.withColumn("__part", F.when(F.col("__one"), F.col("__tie")).otherwise(0)).drop("__one")


def number_shards(keyed: DataFrame, shards: int, tolerance: float, rows_per_task: int) -> DataFrame:
    """``keyed`` (stored, from :func:`with_keys`) with ``shard`` and ``slot`` for its key columns."""
    narrow = keyed.select(F.col("__key").alias("key"), "size")
    placed = _ranges(keyed, find_splitters(narrow, shards, tolerance), rows_per_task)
    here = ["shard", "__from", "__part"]
    counts = placed.groupBy(*here).agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("__from", "__part").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select(*here, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    numbered = placed.withColumn("slot", F.row_number().over(W.partitionBy(*here).orderBy("__key", "__tie")) - 1)
    joined = numbered.join(ahead, here).withColumn("slot", (F.col("slot") + F.col("__ahead")).cast("long"))
    return joined.drop("__key", "__tie", "__from", "__part", "__ahead")


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.002,
    rows_per_task: int = 500_000,
    with_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` plus ``size, text_crc32, shard, slot``; shards hold near-equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 16. Rows are
    in order of (CRC of the text, hash of the id) across shards and slots, at
    every size. Rows that agree in both (repeated rows) share a shard and stand
    together in any order. Slots are gapless from 0 within a shard. The table is
    read once, and written with its keys; all counting reads the keys' columns
    of that. Without ``with_text`` no text is carried. An empty table gives an
    empty result. Columns with the result's names are replaced.
    """
    keyed = with_keys(docs, id_col, text_col)
    return number_shards(stored(keyed if with_text else keyed.drop(text_col), "keyed-rows"), shards, tolerance, rows_per_task)


def op1_histogram_shards(spark, sf_dir):
    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 40, with_text=False)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
