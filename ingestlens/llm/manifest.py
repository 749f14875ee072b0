"""Merkle manifest of a dataset: a tree of three per source, a tree over the sources, and a proof for every row.

The leaves of a source stand in aligned blocks of ``3 ** LEVELS``. A block keeps
each of its levels as one string of hex digests: a level's parents are the
hashes of its 192-character substrings, and what flanks a digest within such a
substring are its siblings. The blocks' own roots are the leaves of the next
round, until one is left of every source; the sources' roots are the last group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import stored, table
from ingestlens.llm.numbering import placed

#: Levels that a block holds: 729 leaves, 47 kB of digests at its lowest level.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; null is ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """Digest of a row's :data:`FIELDS`, with another ``text`` where one is given."""
    return F.sha2(F.concat(*[field(F.col(c) if text is None or c != "text" else text) for c in FIELDS]), 256)


def _level(k: int) -> str:
    return f"__level{k}"


def _blocks(nodes: DataFrame) -> DataFrame:
    """``__group, __block, __n, __nodes, __height``, the levels and ``__root`` of every aligned block.

    ``nodes`` has ``__group, __pos, __n, __digest`` and what its rows carry.
    ``__height`` is how many levels lie above the block's nodes within it: all
    :data:`LEVELS` where the group has more nodes than a block holds.
    """
    size = 3**LEVELS
    rows = F.struct("__pos", *[c for c in nodes.columns if c not in ("__group", "__pos", "__n", "__part")])
    blocks = (
        nodes.groupBy("__group", "__n", F.expr(f"__pos div {size}").alias("__block"))
        .agg(F.sort_array(F.collect_list(rows)).alias("__nodes"))
        .withColumn("__height", sum((F.col("__n") > 3**k).cast("int") for k in range(LEVELS)))
        # As bytes, so that a substring is cut in constant time.
        .withColumn(_level(0), F.array_join("__nodes.__digest", "").cast("binary"))
    )
    for k in range(LEVELS):
        parents = f"transform(sequence(0, cast(octet_length({_level(k)}) - 1 as int) div 192), i -> sha2(substring({_level(k)}, i * 192 + 1, 192), 256))"
        up = F.when(F.col("__height") > k, F.array_join(F.expr(parents), "").cast("binary"))
        blocks = blocks.withColumn(_level(k + 1), up)
    top = F.coalesce(*[F.col(_level(k)) for k in range(LEVELS, -1, -1)])
    return blocks.withColumn("__root", top.cast("string"))


def _siblings(k: int) -> str:
    """What flanks, within its run of level ``k``, the digest above the node at place ``at`` of the block."""
    nth = f"(at div {3**k})"
    run, own = f"substring({_level(k)}, ({nth} div 3) * 192 + 1, 192)", f"({nth} % 3) * 64"
    return f"struct(cast(substring({run}, 1, {own}) as string) as before, cast(substring({run}, {own} + 65, 128) as string) as after)"


def _unfold(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each node of the blocks with ``__path`` (its siblings up to the last root) and what ``above`` tells of its block's root."""
    joined = blocks.join(above, ["__group", "__block"])
    kept = [c for c in above.columns if c not in ("__group", "__block", "__above")]
    one = joined.select("__group", *kept, "__above", "__height", *[_level(k) for k in range(LEVELS)], F.posexplode("__nodes").alias("at", "__node"))
    own = F.expr(f"slice(array({', '.join(f'case when __height > {k} then {_siblings(k)} end' for k in range(LEVELS))}), 1, __height)")
    return one.select("__group", *kept, F.concat(own.cast(_PATH), "__above").alias("__path"), "__node.*")


def _tree(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, lowest first, and ``__group, __root`` of the finished groups."""
    rounds, roots = [], []
    while True:
        blocks = stored(_blocks(nodes), f"{name}-{len(rounds)}")
        rounds.append(blocks)
        roots.append(blocks.filter(f"__n <= {3**LEVELS}").select("__group", "__root"))
        nodes = blocks.filter(f"__n > {3**LEVELS}").select(
            "__group", F.col("__block").alias("__pos"), F.expr(f"(__n - 1) div {3**LEVELS} + 1").alias("__n"), F.col("__root").alias("__digest")
        )
        if nodes.isEmpty():
            out = roots[0]
            for r in roots[1:]:
                out = out.unionByName(r)
            return rounds, out


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the lowest round with their paths; ``tops`` has ``__group, __path`` and more for every group's root."""
    nodes = None
    for blocks in reversed(rounds):
        above = tops.withColumn("__block", F.lit(0).cast("long"))
        ends = _unfold(blocks.filter(f"__n <= {3**LEVELS}"), above.withColumnRenamed("__path", "__above"))
        if nodes is not None:
            upper = nodes.select("__group", *[c for c in tops.columns if c not in ("__group", "__path")], F.col("__pos").alias("__block"), F.col("__path").alias("__above"))
            ends = ends.unionByName(_unfold(blocks.filter(f"__n > {3**LEVELS}"), upper))
        nodes = ends
    return nodes


def fold(digest: str, path: str) -> Column:
    """The root that a digest and its siblings, level by level, lead to."""
    return F.expr(f"aggregate({path}, {digest}, (h, s) -> sha2(concat(s.before, h, s.after), 256))")


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    ``docs`` has the columns :data:`FIELDS`; others are ignored, whatever their
    names. Any of the five may be null, in a row or in all. Rows of a null
    source are a source of their own, the first; a null ``doc_id`` comes before
    the others of its source. Rows of one source and id are put in order of
    their leaves; where those are equal too, the rows take adjacent places in
    any order. ``tampered_text`` is the text found later, from which
    ``folded_root`` is computed with the siblings of the first reading; without
    it the rows' own leaf is folded. An empty table gives an empty result; a
    text's length matters to its own hash only, for no text leaves its row.
    """
    leaf = leaf_hash()
    found = leaf if tampered_text is None else leaf_hash(tampered_text)
    # Encoded so that null comes first and the order is that of the bytes.
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(group.alias("__group"), "doc_id", leaf.alias("__digest"), F.nullif(found, leaf).alias("__found"))
    leaves = stored(leaves.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    rounds, subroots = _tree(placed(leaves, "__group", ["doc_id", "__digest", "__tie"], "ordered-leaves").drop("__tie"), "blocks")
    sources = subroots.select(F.lit("").alias("__group"), F.col("__group").alias("source"), F.col("__root").alias("__digest"))
    top_rounds, top = _tree(placed(sources, "__group", ["source"], "ordered-sources"), "source-blocks")
    tops = top.select("__group", F.col("__root").alias("root"), F.lit([]).cast(_PATH).alias("__path"))
    by_source = _descend(top_rounds, tops).select(F.col("source").alias("__group"), F.col("__digest").alias("subroot"), "root", "__path")
    rows = _descend(rounds, by_source)
    proof = F.sha2(F.array_join(F.transform("__path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = fold("coalesce(__found, __digest)", "__path")
    out = rows.select("doc_id", F.col("__digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir):
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


#: CRC-32 of decimal ids, from its rule: ``crc(s, v)`` after ``CRC_SQL.format(ids=...)``.
CRC_SQL = r"""with recursive bytes_(i, k, v) as (
  select range, 0, range from range(256) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bytes_ where k < 8),
crc_(s, k, acc) as (
  select distinct s, 0, 4294967295 from ({ids}) union all
  select s, c.k + 1, xor(acc >> 8, b.v) from crc_ c join bytes_ b on b.k = 8 and b.i = xor(acc & 255, ascii(substr(s, c.k + 1, 1))) where c.k < length(s)),
crc as (select s, xor(acc, 4294967295) v from crc_ where k = length(s))"""

_FIELD_SQL = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _hash_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD_SQL.format(text if c == "text" else c) for c in FIELDS) + ")"


#: Trees of at most 12 levels (531,441 leaves a source), level by level.
OP11_SQL = (
    CRC_SQL.format(ids="select doc_id::varchar s from documents")
    + f""",
d as (
  select row_number() over () id, doc_id, coalesce('=' || source, '') g, {_hash_sql("text")} leaf,
         case when v % 2 = 0 then {_hash_sql("replace(text, chr(10), '')")} else {_hash_sql("text")} end found
  from documents left join crc on s = doc_id::varchar),
n0 as (select id, g, leaf h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 pos from d),
l0 as (select g, pos, h, count(*) over (partition by g) n from n0)"""
    + "".join(f", l{k} as (select g, pos // 3 pos, sha256(string_agg(h, '' order by pos)) h, count(*) over (partition by g) n from l{k - 1} where n > 1 group by g, pos // 3)" for k in range(1, 13))
    + ", low as ("
    + " union all ".join(f"select {k} k, * from l{k}" for k in range(13))
    + "), subs as (select g, h from low where n = 1), "
    + "s0 as (select g, '' t, row_number() over (order by g) - 1 pos, h, count(*) over () n from subs)"
    + "".join(f", s{k} as (select pos // 3 pos, sha256(string_agg(h, '' order by pos)) h, count(*) over () n from s{k - 1} where n > 1 group by pos // 3)" for k in range(1, 8))
    + ", high as ("
    + " union all ".join(f"select {k} k, pos, h, n from s{k}" for k in range(8))
    + """),
sib as (
  select n0.id, low.k, string_agg(case when low.pos < n0.pos // (3 ** low.k)::bigint then h2 end, '' order by low.pos) before,
         string_agg(case when low.pos > n0.pos // (3 ** low.k)::bigint then h2 end, '' order by low.pos) after
  from n0 join (select *, h h2 from low where n > 1) low on low.g = n0.g and low.pos // 3 = n0.pos // (3 ** (low.k + 1))::bigint group by 1, 2
  union all
  select n0.id, 100 + high.k, string_agg(case when high.pos < s0.pos // (3 ** high.k)::bigint then h2 end, '' order by high.pos),
         string_agg(case when high.pos > s0.pos // (3 ** high.k)::bigint then h2 end, '' order by high.pos)
  from n0 join s0 using (g) join (select *, h h2 from high where n > 1) high on high.pos // 3 = s0.pos // (3 ** (high.k + 1))::bigint group by 1, 2),
p as (select id, row_number() over (partition by id order by k) nth, coalesce(before, '') before, coalesce(after, '') after from sib),
f(id, nth, h) as (select id, 0::bigint, found from d union all select f.id, f.nth + 1, sha256(before || h || after) from f join p on p.id = f.id and p.nth = f.nth + 1),
folded as (select id, arg_max(h, nth) h from f group by 1),
proof as (select id, sha256(string_agg(before || after, '' order by nth)) h from p group by 1)
select d.doc_id, leaf, subs.h subroot, top.h root, coalesce(proof.h, sha256('')) proof_sha256, folded.h folded_root, folded.h = top.h verified
from d join subs using (g) cross join (select h from high where n = 1) top join folded using (id) left join proof using (id)
"""
)
