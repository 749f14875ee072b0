"""Sharding and packing: laws, bounds and exact round trips."""

import zlib

import numpy as np
import pytest
from conftest import SMALL

from ingestlens.llm import packing
from ingestlens.llm.sharding import find_splitters, shard_by_bytes, sort_key


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, shard int")


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    for r in got:
        assert (r["size"], r["text_crc32"]) == (size(r["text"]), zlib.crc32((r["text"] or "").encode()))
        assert 0 <= r["shard"] < shards
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return {k: sum(r["size"] for r in got if r["shard"] == k) for k in range(shards)}


def test_equal_bytes_with_a_hot_text(spark):
    rows = [(i, "hot text of many copies" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    sums = check_shards(rows, shard_by_bytes(frame(spark, rows), 10).collect(), 10)
    mean = sum(sums.values()) / 10
    assert max(abs(s - mean) for s in sums.values()) < 0.02 * mean + 400


def test_parts_keep_slots_gapless(spark):
    rows = [(i, f"t{i}") for i in range(500)]
    check_shards(rows, shard_by_bytes(frame(spark, rows), 4, rows_per_task=20).collect(), 4)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a"), (3, "a"), (4, "x" * 200_000), (5, "é😀")]
    check_shards(rows, shard_by_bytes(frame(spark, rows), 40).collect(), 40)
    assert shard_by_bytes(frame(spark, rows).limit(0), 40).count() == 0


def test_splitters_are_exact_counts(spark):
    df = spark.range(2000).selectExpr("id doc_id", "id % 7 + 1 size", "crc32(cast(cast(id % 50 as string) as binary)) crc")
    from pyspark.sql import functions as F

    keyed = df.select(sort_key("doc_id", F.col("crc")).alias("key"), "size")
    cuts = find_splitters(keyed, 8, tolerance=0.01)
    rows = keyed.collect()
    total = sum(r["size"] for r in rows)
    for i, c in enumerate(cuts, 1):
        assert abs(sum(r["size"] for r in rows if r["key"] < c) - i * total / 8) <= 0.01 * total / 8 + 7


def test_pieces_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "one", "many words here " * 900, "tail <|endoftext|> x", "日本語 text 😀 ͸", "a" * 3000, "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "x")]
    packed = packing.pack_documents(frame(spark, rows), with_ids=True)
    got = packed.collect()
    pieces = {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["length"] == len(ids) <= 1024 and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces.setdefault(r["doc_id"], {}).setdefault(r["piece"], (r["start"], ids.tolist()))
    for i, t in enumerate(texts):
        want = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        mine = [x for p in sorted(pieces[i]) for x in pieces[i][p][1]]
        assert mine == want
        assert [pieces[i][p][0] for p in sorted(pieces[i])] == list(np.cumsum([0] + [len(pieces[i][p][1]) for p in sorted(pieces[i])])[:-1])
        assert all(len(pieces[i][p][1]) == 1024 for p in sorted(pieces[i])[1:])
    assert len(got) == sum(len(p) for p in pieces.values()) + 1  # the repeated row
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def test_plan_packs_every_piece_once():
    rng = np.random.default_rng(1)
    for n in (1, 50, 5000):
        h = np.bincount(rng.integers(1, 1025, n), minlength=1025)
        used, count = np.zeros(1025, int), 0
        for pattern, times in packing.pack_histogram(h, 1024):
            assert sum(k * m for k, m in pattern) <= 1024
            for k, m in pattern:
                used[k] += m * times
            count += times
        assert (used == h).all()
        assert count <= 1.02 * -(-int((h * np.arange(1025)).sum()) // 1024) + (1 if n > 1 else 0) or n < 100


def test_near_the_bound_on_documents(spark):
    got = packing.op10_pattern_packing(spark, SMALL).collect()
    bound = -(-sum(r["length"] for r in got) // 1024)
    assert len({r["sequence_id"] for r in got}) <= 1.03 * bound + 1


@pytest.mark.parametrize("text", ["plain", "Élan vital", "a\x1cb\x85c d", "x  \n\n  y", "'ll 've 12'3"])
def test_fast_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing._encoder(None, None)(text).tolist() == exact.encode(text, add_special_tokens=False).ids
