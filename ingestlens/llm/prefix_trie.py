"""Prefix trie of conversations rebuilt from another's head and their own rest, by composable fingerprints.

A sequence of turns is fingerprinted by a product: the empty sequence is 0, one
turn more makes it ``f * BASE + x`` modulo a prime. The product of a stretch
follows from those of the two prefixes that end and begin it, and that of a
rebuilt conversation from its base's head and its own rest, so no rebuilt text
is ever made. A turn's ``x`` is its content's reference: digests of which each
was shown to stand for a single (role, text). A node's rows must agree in their
last reference, and so, prefix by prefix, in all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import stored, table
from ingestlens.llm.manifest import CRC_SQL

#: A prime, so that BASE has an inverse: a node's parent is ``(f - x) / BASE``.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
INVERSE = pow(BASE, -1, PRIME)
EMPTY = bytes(16)
FAMILY, CUTS = 5, 9
#: Parts into which the conversations that ask for one node's smallest member are dealt.
SALTS = 32
#: Ids that are joined in one task before they are hashed in order.
IDS_PER_PIECE = 20_000


def _number(b: bytes | None) -> int:
    return int.from_bytes(b or EMPTY, "big")


def _bytes(n: int) -> bytes:
    return (n % PRIME).to_bytes(16, "big")


def _with(df: DataFrame, fields: str, fn) -> DataFrame:
    """``df`` with further columns that ``fn`` gives as lists from a batch's columns (a dict of lists)."""
    schema = df.limit(0).selectExpr("*", *[f"cast(null as {f.split()[1]}) {f.split()[0]}" for f in fields.split(", ")]).schema
    names = df.columns
    kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"task": TaskContext.get().partitionId()}
        for batch in batches:
            new = fn({n: batch.column(n).to_pylist() for n in fn.needs}, state)
            arrays = [batch.column(n) for n in names] + [pa.array(v, t) for v, t in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return df.mapInArrow(run, schema)


def _scan(cols: dict, state: dict) -> tuple[list, ...]:
    """Place, product and bytes up to each row among the rows of its conversation in this task; rows come in order."""
    conv, at, f, size = state.get("at", (None, 0, 0, 0))
    places, products, sizes = [], [], []
    for c, ref, n in zip(cols["conv_id"], cols["ref"], cols["bytes"], strict=True):
        if c != conv:
            conv, at, f, size = c, 0, 0, 0
        at, f, size = at + 1, (f * BASE + _number(ref)) % PRIME, size + n
        places.append(at)
        products.append(_bytes(f))
        sizes.append(size)
    state["at"] = conv, at, f, size
    return [state["task"]] * len(places), places, products, sizes


_scan.needs = ("conv_id", "ref", "bytes")


def _after(cols: dict, state: dict) -> tuple[list]:
    """Product of ``head`` followed by what ``f`` has beyond its first ``cut`` turns, whose own product is ``cut_f``."""
    out = []
    for head, cut, cut_f, at, f in zip(*[cols[n] for n in _after.needs], strict=True):
        if head is None and cut_f is None:
            out.append(f)
        else:
            out.append(_bytes(_number(f) + (_number(head) - _number(cut_f)) * pow(BASE, at - cut, PRIME)))
    return (out,)


_after.needs = ("head", "cut", "cut_f", "at", "f")


def _parent(cols: dict, state: dict) -> tuple[list]:
    return ([None if f is None or d == 0 else _bytes((_number(f) - _number(x)) * INVERSE) for d, f, x in zip(*[cols[n] for n in _parent.needs], strict=True)],)


_parent.needs = ("depth", "f", "ref")


def check_references(turns: DataFrame) -> None:
    """Stops unless every reference of ``turns`` (ref, role, text) stands for one content; equal turns are merged before they are moved."""
    contents = turns.groupBy("ref", "role", "text").count().groupBy("ref").count()
    if not contents.filter("count > 1").isEmpty():
        raise ValueError("two turns share a reference")


def turn_products(turns: DataFrame) -> DataFrame:
    """``conv_id, part, at, ref, bytes, f, upto`` of every turn: place from 1, product and bytes of the conversation up to it.

    A conversation's turns are dealt by ranges, so a long one is in several
    tasks; ``part`` is the task's number. Only the ends of those that pass from
    one task into the next are combined, less than two a task.
    """
    ranged = turns.repartitionByRange("conv_id", "turn", "ref", "tie").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "ref", "tie")
    local = stored(_with(ranged.select("conv_id", "ref", "bytes"), "part bigint, here bigint, here_f binary, here_bytes bigint", _scan), "turn-products")
    ends = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("here", "here_f", "here_bytes"), "here").alias("e"))
    crossing = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "e.here", "e.here_f", "e.here_bytes"))).alias("parts")).filter("size(parts) > 1")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                at, f, size = 0, 0, 0
                for p in parts:
                    if at:
                        rows.append((c, p["part"], at, _bytes(f), size))
                    at, f, size = at + p["here"], f * pow(BASE, p["here"], PRIME) + _number(p["here_f"]), size + p["here_bytes"]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "part", "ahead", "head", "ahead_bytes"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    ahead = crossing.mapInArrow(carry, f"conv_id {kind}, part bigint, ahead bigint, head binary, ahead_bytes bigint")
    # At most one row a task: the conversation that an earlier one began.
    joined = local.join(F.broadcast(ahead), ["conv_id", "part"], "left").select(
        "conv_id", "part", "ref", "bytes", (F.col("here") + F.coalesce("ahead", F.lit(0))).alias("place"), (F.col("here_bytes") + F.coalesce("ahead_bytes", F.lit(0))).alias("upto"),
        F.col("here").alias("at"), F.col("here_f").alias("f"), "head", F.lit(0).cast("long").alias("cut"), F.lit(None).cast("binary").alias("cut_f"),
    )
    whole = _with(joined, "product binary", _after)
    return stored(whole.select("conv_id", "part", F.col("place").alias("at"), "ref", "bytes", F.col("product").alias("f"), "upto"), "turns")


def rebuilt_prefixes(turns: DataFrame, cut: Column, base: Column) -> DataFrame:
    """``conv_id, part, depth, f, ref, bytes, upto`` of every prefix of every rebuilt conversation, the empty one included.

    A conversation is the first ``cut`` turns of ``base`` and its own after its
    first ``cut``. ``turns`` is from :func:`turn_products`. Bases give at most
    ``CUTS - 1`` turns to at most ``FAMILY`` conversations.
    """
    parts = turns.select("conv_id", "part").distinct()
    convs = parts.select("conv_id").distinct().select("conv_id", cut.alias("cut"), base.alias("base"))
    # Its own base keeps all turns.
    foreign = convs.filter("base <> conv_id and cut > 0")
    own = turns.filter(F.col("at") < CUTS)
    first = own.select(F.col("conv_id").alias("base"), "at", "ref", "bytes", "f", "upto")
    heads = foreign.join(first, "base").filter("at <= cut").select("conv_id", F.lit(-1).cast("long").alias("part"), F.col("at").alias("depth"), "f", "ref", "bytes", "upto")
    last = heads.groupBy("conv_id").agg(F.max_by(F.struct("depth", F.col("f").alias("head"), F.col("upto").alias("head_bytes")), "depth").alias("h"))
    at_cut = own.join(foreign, "conv_id").filter("at = cut").select("conv_id", F.col("f").alias("cut_f"), F.col("upto").alias("cut_bytes"))
    joints = foreign.select("conv_id", "cut").join(last, "conv_id", "left").join(at_cut, "conv_id", "left").select("conv_id", "cut", "h.*", "cut_f", "cut_bytes")
    # By (conversation, part), so that a long conversation stays in as many tasks as it was.
    by_part = parts.join(joints, "conv_id").withColumnRenamed("depth", "head_n")
    joined = turns.join(by_part, ["conv_id", "part"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)).cast("long")).filter("at > cut")
    moved = _with(joined, "product binary", _after).select(
        "conv_id", "part", (F.col("at") - F.col("cut") + F.coalesce("head_n", F.lit(0))).alias("depth"), F.col("product").alias("f"), "ref", "bytes",
        (F.col("upto") - F.coalesce("cut_bytes", F.lit(0)) + F.coalesce("head_bytes", F.lit(0))).alias("upto"),
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", F.lit(-1).cast("long").alias("part"), zero.alias("depth"), F.lit(EMPTY).alias("f"), F.lit(EMPTY).alias("ref"), zero.alias("bytes"), zero.alias("upto"))
    return roots.unionByName(heads).unionByName(moved)


def _ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, f, ends_sha256``: SHA-256 of each node's ending ids, ascending and comma-joined.

    Ids are joined in pieces where the ranges put them; the hash then takes a
    node's pieces in order, as a stream: a node on which very many end is bound
    to one task for its bytes, because the digest is defined so, but neither for
    their joining nor in memory.
    """
    ranged = ends.repartitionByRange("depth", "f", "conv_id").sortWithinPartitions("depth", "f", "conv_id")
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(ends.schema["conv_id"].dataType.simpleString(), pa.string())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), kind, pa.string()))], ["depth", "f", "first", "ids"])

        for batch in batches:
            done = []
            for d, f, c in zip(*[batch.column(n).to_pylist() for n in ("depth", "f", "conv_id")], strict=True):
                if node != (d, f) or len(ids) == IDS_PER_PIECE:
                    if ids:
                        done.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (d, f), []
                ids.append(c)
            if done:
                yield made(done)
        if ids:
            yield made([(*node, ids[0], ",".join(map(str, ids)))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "f", "ends_sha256"])

        for batch in batches:
            done = []
            for d, f, ids in zip(*[batch.column(n).to_pylist() for n in ("depth", "f", "ids")], strict=True):
                if node == (d, f):
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (d, f), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield made(done)
        if node:
            yield made([(*node, digest.hexdigest())])

    joined = ranged.select("depth", "f", "conv_id").mapInArrow(pieces, f"depth bigint, f binary, first {ends.schema['conv_id'].dataType.simpleString()}, ids string")
    return joined.repartition("depth", "f").sortWithinPartitions("depth", "f", "first").mapInArrow(digests, "depth bigint, f binary, ends_sha256 string")


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """The trie of stored ``prefixes`` (:func:`rebuilt_prefixes`): one row per node.

    Nothing walks the tree. Every node has a smallest member, and a conversation
    that is smallest somewhere is so from that depth on (``own_from``). So a
    node's children, the leaves below it and the bytes below it that no other
    node repeats are sums over its members: who begins to be smallest one level
    down, who is smallest at a leaf, and how many bytes lie before ``own_from``.
    """
    merged = prefixes.groupBy("depth", "f").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("ref").alias("ref"), F.max("ref").alias("other"), F.max("bytes").alias("bytes"), F.max("upto").alias("upto")
    )
    same = F.when(F.col("ref") == F.col("other"), F.col("ref")).otherwise(F.raise_error(F.lit("two prefixes share a fingerprint")).cast("binary"))
    checked = merged.withColumn("ref", same).drop("other")
    nodes = stored(_with(checked, "parent_f binary", _parent), "trie-nodes")
    ends = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("depth", "f", "upto"), "depth").alias("e")).select("conv_id", "e.*")
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", (F.col("upto") - F.col("bytes")).alias("shared"))).alias("o"))
    # A leaf is a node with as many ends as members: all of them end there.
    ending = ends.groupBy("depth", "f").agg(F.count("*").alias("n_ends"))
    leaves = nodes.join(ending, ["depth", "f"]).filter("n_ends = n_convs").select("conv_id", F.lit(1).alias("leaf"))
    facts = ends.join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", F.col("depth").alias("length"), F.col("o.depth").alias("own_from"), F.coalesce("o.shared", "upto").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    by_part = prefixes.select("conv_id", "part").distinct().join(facts, "conv_id")
    begins = F.col("own_from") == F.col("depth") + 1
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    sums = (
        prefixes.join(by_part, ["conv_id", "part"])
        .groupBy("depth", "f")
        .agg(
            F.sum(F.when((F.col("own_from") <= F.col("depth") + 1) & (F.col("length") > F.col("depth")), 1).otherwise(0)).alias("n_children"),
            F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
            F.sum(F.greatest(F.lit(0).cast("long"), F.col("shared") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
            # Only the smallest member is so from here or before.
            F.max(F.when(F.col("own_from") <= F.col("depth"), F.col("own_from"))).alias("own_from"),
            F.bit_or(F.when(begins, F.call_function("shiftleft", F.lit(1).cast("long"), salt)).otherwise(F.lit(0).cast("long"))).alias("salts"),
        )
    )
    whole = stored(nodes.join(sums, ["depth", "f"]).join(_ends_digest(ends), ["depth", "f"], "left"), "trie-sums")
    # A conversation that is smallest in the parent too answers for itself; the others ask their node's parent.
    asking = whole.filter("depth = own_from and depth > 0").withColumn("salt", salt)
    asked = whole.filter("salts <> 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("f").alias("parent_f"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (salts & shiftleft(1L, s)) <> 0)")).alias("salt"),
    )
    others = whole.filter("depth <> own_from or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return asking.join(asked, ["depth", "parent_f", "salt"]).select(*columns).unionByName(others.select(*columns))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node of the trie.

    Every conversation c is rebuilt from the first h turns of ``c - c % 5`` and
    its own after its first h, h being CRC-32 of c in decimals modulo 9. Turns
    are in order of their number, null first; equal numbers in order of
    :func:`reference`. Repeated rows are repeated turns; a null role or text is
    empty. Rows without a conversation id belong to no conversation and to no
    node. An empty table has no node, not even a root. Other columns are
    ignored, whatever their names. Texts are read once for their references and
    once to compare what shares one; nothing after that holds a text.
    """
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.withColumn("ref", reference())
    check_references(rows)
    narrow = stored(rows.select("conv_id", "turn", "ref", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")), "turn-references")
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(CUTS))
    prefixes = rebuilt_prefixes(turn_products(narrow), cut, F.col("conv_id") - F.col("conv_id") % FAMILY)
    return trie_nodes(stored(prefixes, "rebuilt-prefixes"))


def reference() -> Column:
    """16 bytes that stand for a turn's content."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Prefixes are told apart by the digests of all their turns, joined; subtrees by joining every prefix of every conversation.
OP13_SQL = (
    CRC_SQL.format(ids="select conv_id::varchar s from conversations where conv_id is not null")
    + r""",
t as (
  select conv_id c, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) r, strlen(coalesce(text, '')) b, turn from conversations where conv_id is not null),
o as (select c, r, b, row_number() over (partition by c order by turn nulls first, r) n from t),
k as (select distinct c, v % 9 h from t join crc on s = c::varchar),
u as (
  select k.c, 0 z, n, r, b from k join o on o.c = k.c - k.c % 5 and n <= h union all
  select k.c, 1, n, r, b from k join o using (c) where n > h),
w as (
  select c, row_number() over x d, sha256(string_agg(r, '') over x) p, b from u window x as (partition by c order by z, n)
  union all select c, 0, '', 0 from k),
m as (select *, lag(p) over (partition by c order by d) q, max(d) over (partition by c) len from w),
nodes as (
  select d, p, min(c) conv_id, any_value(q) q, count(*) n_convs, any_value(b) b,
         string_agg(case when d = len then c::varchar end, ',' order by c) ends from m group by d, p),
kids as (select d - 1 d, q p, count(*) n from nodes where d > 0 group by all),
full_ as (select nodes.*, coalesce(kids.n, 0) n_children from nodes left join kids using (d, p)),
below as (
  select distinct a.d, a.p, z.d zd, z.p zp from m a join m z on a.c = z.c and z.d >= a.d),
sums as (
  select below.d, below.p, sum(case when n_children = 0 then 1 else 0 end)::bigint n_leaves, sum((n_convs - 1) * b)::bigint saved_tokens
  from below join full_ on full_.d = zd and full_.p = zp group by 1, 2)
select f.conv_id, f.d depth, up.conv_id parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) ends_sha256
from full_ f join sums using (d, p) left join full_ up on up.d = f.d - 1 and up.p = f.q
"""
)
