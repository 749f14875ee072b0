"""Near-duplicate detection: SuperMinHash signatures, banding, exact verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestlens.llm import shingles as S
from ingestlens.llm.common import marked, maybe_among, stored, table
from ingestlens.llm.components import components

#: With 32 bands of 4 registers a pair at similarity 0.75 misses every band with probability 5e-6.
REGISTERS, BANDS = 128, 32
#: Documents of a cluster compared at once with others, on either side of a block.
BLOCK = 1024
#: Pairs whose signatures agree in less than this are not verified: five standard deviations under 0.75.
LEAST_AGREEMENT = 0.55
#: The same for a bucket's member and end, before their texts are sent: six standard deviations under 0.75.
LEAST_OF_PAIRS = 0.5
#: A bucket end's members are compared with it in parts of about so many, each with one copy of the end's signature or text.
PART_MEMBERS = 256
#: Counters of the order of shingles by rarity (a byte each in every task); any order is right, a finer one keeps more apart.
COUNTERS = 1 << 20


def _kind(rows: DataFrame, column: str = "id") -> str:
    return rows.schema[column].dataType.simpleString()


def _texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``id, n, set_a, set_b, sig``: size of the shingle set, two keys that equal sets share, the signature's registers at two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("id"), 0
            for block in S.blocks(_texts(batch, "text"), shingle):
                pairs = [S.set_key(s) for s in block]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(block)),
                        pa.array([len(s) for s in block], pa.int64()),
                        pa.array([p[0] for p in pairs], pa.int64()),
                        pa.array([p[1] for p in pairs], pa.int64()),
                        pa.array([r.tobytes() for r in S.registers(S.super_minhash(block, REGISTERS))], pa.binary()),
                    ],
                    names=["id", "n", "set_a", "set_b", "sig"],
                )
                at += len(block)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {_kind(rows)}, n long, set_a long, set_b long, sig binary")


def _bands():
    """The band keys of a signature: a hash for each run of registers and its number."""
    size = 2 * REGISTERS // BANDS
    return F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * size + 1, size)) for k in range(BANDS)])


def _registers(batch, name: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _with_ends(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (``u, v``) with ``facts`` of ``u``, each run of them (``v, part``) behind a row with those of ``v`` (``member`` 0).

    ``v`` is the end of a bucket, which very many may share. A member's facts
    travel once for each of its pairs, an end's once for every part of its
    members; neither is looked up by a key that many rows share.
    """
    given = [c for c in facts.columns if c != "id"]
    busy = pairs.groupBy("v").agg(F.ceil(F.count("*") / PART_MEMBERS).cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    parted = pairs.join(busy, "v", "left").select("u", "v", part)
    members = parted.join(facts.withColumnRenamed("id", "u"), "u").select("v", "part", F.lit(1).alias("member"), "u", *given)
    ends = parted.select("v", "part").distinct().join(facts.withColumnRenamed("id", "v"), "v")
    rows = members.unionByName(ends.select("v", "part", F.lit(0).alias("member"), F.lit(None).cast(_kind(pairs, "u")).alias("u"), *given))
    return rows.repartition("v", "part").sortWithinPartitions("v", "part", "member").select("u", "v", "member", *given)


def _likely(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` that may be similar by set sizes and signatures (``facts``: id, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch in batches:
            sizes, sigs, keep = batch.column("n").to_pylist(), _registers(batch), []
            for member, n, sig in zip(batch.column("member").to_pylist(), sizes, sigs, strict=True):
                if not member:  # comes before its part's members
                    end = (n, sig)
                small, large = sorted((n, end[0]))
                keep.append(bool(member) and 100 * small >= percent * large and (sig == end[1]).mean() >= LEAST_OF_PAIRS)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _with_ends(pairs, facts).mapInArrow(run, f"u {_kind(pairs, 'u')}, v {_kind(pairs, 'v')}")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch in batches:
            keep = []
            for member, text in zip(batch.column("member").to_pylist(), _texts(batch, "text"), strict=True):
                one = S.shingle_set(text, shingle)
                if not member:  # comes before its part's members
                    end = one
                keep.append(bool(member) and _similar(end, one, percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _with_ends(pairs, texts).mapInArrow(run, f"u {_kind(pairs, 'u')}, v {_kind(pairs, 'v')}")


def _ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))


def _rarity(open_texts: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each of ``COUNTERS`` hash classes occur in ``open_texts``, as a logarithm in a byte.

    A task counts to 255, so that its counters are a byte each: past that the order is coarser, which is right too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in _texts(batch, "text"):
                np.add.at(counts, (S.shingle_set(text, shingle) % np.uint64(COUNTERS)).astype(np.int64), 1)
        blocks = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 4096)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[b].tobytes() for b in some], pa.binary())], ["b", "counts"])

    def summed(rows):
        n = sum(np.frombuffer(x, np.uint8).astype(np.int64) for x in rows.column("counts").to_pylist())
        levels = np.where(n > 0, np.minimum(np.floor(np.log2(np.maximum(n, 1)) * 4) + 1, 255), 0).astype(np.uint8)
        return pa.table({"b": rows.column("b").slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})

    blocks = open_texts.select("text").mapInArrow(run, "b long, counts binary").groupBy("b").applyInArrow(summed, "b long, levels binary")
    out = np.zeros(COUNTERS, np.uint8)
    for r in blocks.collect():  # COUNTERS bytes at most
        out[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["levels"], np.uint8)
    return out


def _prefixes(open_texts: DataFrame, rarity: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """``id, prefix``: for every document of ``open_texts`` (id, text) its shingles up to the necessary prefix in order of rarity.

    Two sets of ``percent`` per cent similarity share a shingle among the first
    n - ceil(n * percent / 100) + 1 of each, in any one order. One that the
    counters show to be a single document's own is left out.
    """
    shared = open_texts.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            found = []
            for text in _texts(batch, "text"):
                one = S.shingle_set(text, shingle)
                level = rarity[(one % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((one, level))[: len(one) - -(-len(one) * percent // 100) + 1]
                found.append(one[first[level[first] > 1]])
            at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), prefix], ["id", "prefix"])

    return open_texts.select("id", "text").mapInArrow(run, f"id {_kind(open_texts)}, prefix array<long>")


def _reachable(open_: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``open_`` (id, comp) with ``cluster``: components between which a link is still possible, as they share a prefix shingle.

    Documents that cannot be similar to any outside their component are not
    returned. Work is linear in the shingles: components that share one are
    joined to the least of them, not to each other. Texts are read where they
    are stored, only their prefixes travel.
    """
    open_texts = maybe_among(texts, open_, "id")
    prefixes = _prefixes(open_texts, _rarity(open_texts, shingle), shingle, percent)
    with_comp = stored(open_.join(prefixes, "id").select("comp", "prefix"), "prefix-shingles")
    shared = with_comp.select("comp", F.explode("prefix").alias("h"))
    least = shared.groupBy("h").agg(F.min("comp").alias("v"), F.max("comp").alias("most")).filter("v < most").select("h", "v")
    links = shared.join(least, "h").filter("comp <> v").select(F.col("comp").alias("u"), "v").distinct()
    return open_.join(components(links).withColumnsRenamed({"id": "comp", "component": "cluster"}), "comp")


def _alike(rows: DataFrame, percent: int) -> DataFrame:
    """Of each block of ``rows`` (block keys, side, id, comp, n, sig) what :func:`_across` may link: block keys, side and id.

    A document of side 0 and one of any side, of unlike components, whose set sizes and signatures allow it.
    """

    def run(table_):
        side = np.asarray(table_.column("side"))
        sizes, sigs = np.asarray(table_.column("n")), _registers(table_)
        comps = [tuple(c.values()) if isinstance(c, dict) else c for c in table_.column("comp").to_pylist()]
        numbers = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        group = np.array([numbers[c] for c in comps])
        keep = np.zeros(len(side), bool)
        for i in np.flatnonzero(side == 0):
            may = (group != group[i]) & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes)
            at = np.flatnonzero(may)
            at = at[(sigs[at] == sigs[i]).mean(1) >= LEAST_AGREEMENT]
            keep[at] = True
            keep[i] |= len(at) > 0
        return table_.select(["cluster", "row_block", "col_block", "side", "id"]).filter(pa.array(keep))

    kinds = ", ".join(f"{c} {_kind(rows, c)}" for c in ("cluster", "row_block", "col_block", "side", "id"))
    return rows.groupBy("cluster", "row_block", "col_block").applyInArrow(run, kinds)


def _across(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links ``u, v`` between components inside each block of ``rows`` (block keys, side, id, comp, text).

    Side 0 holds documents outside their cluster's main component, side 1 any
    others to compare them with. Likeliest pairs come first and what is joined
    already is skipped, so a block gives fewer links than it has components.
    """

    def run(table_):
        side = np.asarray(table_.column("side"))
        order = np.argsort(side, kind="stable")
        ids, comps = (table_.column(c).to_pylist() for c in ("id", "comp"))
        texts = table_.column("text").to_pylist()
        comps = [tuple(c.values()) if isinstance(c, dict) else c for c in comps]
        ids, comps, texts = ([x[i] for i in order] for x in (ids, comps, texts))
        sets = [S.shingle_set(t, shingle) for t in texts]
        sizes = np.array([len(s) for s in sets])
        n = int((side == 0).sum())
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        values = np.concatenate([S.super_minhash(sets[i : i + 64], REGISTERS) for i in range(0, len(sets), 64)])
        values = S.mix(values.view(np.uint64)).astype(np.uint32)
        numbers = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        group = np.array([numbers[c] for c in comps])
        found = []
        for i in range(n):
            agree = (values == values[i]).mean(1)
            near = (agree >= LEAST_AGREEMENT) & (group != group[i])
            near &= (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes)
            found += [(-agree[j], i, j) for j in np.flatnonzero(near)]
        links = []
        for _, i, j in sorted(found):
            if root(comps[i]) != root(comps[j]) and _similar(sets[i], sets[j], percent):
                parent[root(comps[i])] = root(comps[j])
                links.append((ids[i], ids[j]))
        kind = table_.schema.field("id").type
        return pa.table({"u": pa.array([x[0] for x in links], kind), "v": pa.array([x[1] for x in links], kind)})

    return rows.groupBy("cluster", "row_block", "col_block").applyInArrow(run, f"u {_kind(rows)}, v {_kind(rows)}")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, kept``, and ``text_hash, first`` to tell rows of one id apart.

    Documents whose sets of ``shingle``-word shingles have a Jaccard similarity
    of ``percent`` per cent or more are linked; a component is named by its
    smallest id, which is the one kept. Equal sets are one node throughout.
    Null texts and texts without words have no shingles and no links. A node is
    an id with a text: rows that agree in both are one, rows of one id with
    unlike texts are linked each for itself. ``first`` is whether the row's node
    is the least of its component, so of several rows of the kept id only one
    text's are. Rows without id are never linked and each stays. Columns of
    ``docs`` other than these two are ignored, whatever their names; an empty
    table gives an empty result.

    Work on a bucket is linear in its size: its members are verified against its
    two ends only. What that leaves apart inside a cluster of candidates is
    split further by shared shingles of their prefixes, without which no link is
    possible: pages of one template that differ in the rest fall apart here. The
    few that still share one are compared in blocks, each document outside the
    main component with all others, first by signature and then on the full
    sets, so no link depends on which document was the pivot. Ids may be of any
    type that can be ordered.
    """
    node = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    docs = docs.select(F.when(F.col(id_col).isNotNull(), node).alias("node"), F.col(text_col).alias("text"))
    id_col, text_col = "node", "text"
    sketched = stored(sketches(docs, id_col, text_col, shingle), "sketches")
    filled = sketched.filter("n > 0 and id is not null")
    counted = filled.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    equal = stored(counted.filter("rows > 1").select("set_a", "set_b", "rep"), "equal-sets")
    # A set of one row is a class of its own, whose signature need not travel.
    split = marked(filled, equal, "set_a", "set_b")
    several = split.filter("maybe").groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = split.filter("not maybe").select("id", "n", "sig").unionByName(stored(several.select("id", "n", "sig"), "classes"))

    # Which buckets may hold several is counted by 32 bits of their key; only their members travel with their id.
    members = classes.select(F.col("id").alias("rep"), F.explode(_bands()).alias("bucket")).withColumn("slot", F.col("bucket").bitwiseAND(F.lit((1 << 32) - 1)))
    busy = stored(members.groupBy("slot").count().filter("count > 1").select("slot"), "busy-buckets")
    members = stored(maybe_among(members, busy, "slot").drop("slot"), "bucket-members")
    ends = members.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    met = members.join(ends, "bucket")
    either = F.explode(F.when(F.col("rep") == F.col("high"), F.array("low")).otherwise(F.array("low", "high")))
    met = met.filter("rep <> low").select(F.col("rep").alias("u"), either.alias("v"))
    # Two that are each other's end in different buckets are one pair.
    once = met.groupBy(F.least("u", "v"), F.greatest("u", "v")).agg(F.max("u").alias("u"), F.min("v").alias("v"))
    pairs = stored(once.select("u", "v"), "candidates")
    wanted = stored(_ends_of(pairs).distinct(), "candidate-ids")
    # Rows that agree in id and text are one; that they are several is seen where they meet by id.
    texts = stored(maybe_among(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, "id"), "candidate-texts")
    text_of = lambda ids: maybe_among(texts, ids, "id").dropDuplicates(["id"])
    facts = stored(maybe_among(classes, wanted, "id"), "candidate-signatures")
    likely = stored(_likely(pairs, facts, percent), "likely")
    links = stored(_verified(likely, text_of(_ends_of(likely)), shingle, percent), "verified")

    cluster = components(pairs).withColumnRenamed("component", "cluster")
    comp = components(links).withColumnRenamed("component", "comp")
    state = cluster.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def with_main(rows: DataFrame) -> DataFrame:
        """Of ``rows`` (id, comp, cluster) those of clusters with several components; ``side`` 1 in the largest, else 0."""
        sizes = rows.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
        main = sizes.groupBy("cluster").agg(
            F.max(F.struct("n", "comp")).getField("comp").alias("main"), F.sum("n").alias("size"), F.count("*").alias("comps")
        ).filter("comps > 1")
        return rows.join(main, "cluster").withColumn("side", (F.col("comp") == F.col("main")).cast("int"))

    apart = stored(with_main(state).select("id", "comp"), "apart")
    open_ = stored(with_main(_reachable(apart, texts, shingle, percent)), "open")
    strays = open_.groupBy("cluster").agg(F.sum(1 - F.col("side")).alias("strays"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    spread = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    open_ = open_.join(strays, "cluster").withColumns({"rows": blocks("strays"), "cols": blocks("size")})
    # A stray is a row of one row block, in all column blocks; every document is a column of one column block, in all row blocks.
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_row = open_.filter("side = 0").select("cluster", spread("row", F.col("rows")).alias("row_block"), grid("cols").alias("col_block"), F.lit(0).alias("side"), "id", "comp")
    as_col = open_.select("cluster", grid("rows").alias("row_block"), spread("col", F.col("cols")).alias("col_block"), F.lit(1).alias("side"), "id", "comp")
    alike = stored(_alike(as_row.unionByName(as_col).join(facts, "id"), percent), "alike")
    meet = alike.join(open_.select("id", "comp"), "id").join(text_of(alike.select("id")), "id")
    more = _across(meet, shingle, percent)
    linked = components(stored(links.unionByName(more), "all-links"))

    named = equal.join(linked.select(F.col("id").alias("rep"), F.col("component").alias("__found")), "rep", "left")
    by_set = named.select("set_a", "set_b", F.coalesce("__found", "rep").alias("of_set"))
    return (
        sketched.select("id", "n", "set_a", "set_b")
        .join(by_set, ["set_a", "set_b"], "left")
        .join(linked, "id", "left")
        .withColumn("component", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("of_set", "component", "id")).otherwise(F.col("id")))
        .select(
            "id.id",
            F.col("n").alias("n_shingles"),
            F.col("component.id").alias("component_id"),
            F.col("id.id").eqNullSafe(F.col("component.id")).alias("kept"),
            "id.text_hash",
            F.col("id").eqNullSafe(F.col("component")).alias("first"),
        )
    )


def op3_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: Every pair of documents that share a shingle is counted exactly; for small tables.
OP3_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as h
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b using (h) where a.doc_id <> b.doc_id group by all),
links as (
  select u, v from both_ join n as x on x.doc_id = u join n as y on y.doc_id = v where 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) as (
  select doc_id, doc_id from d union select reach.a, links.v from reach join links on reach.b = links.u)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, least_id as component_id, doc_id = least_id as kept
from d left join n using (doc_id) join (select a, min(b) as least_id from reach group by a) on a = doc_id
"""
