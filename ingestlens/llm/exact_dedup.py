"""Exact deduplication by skew-safe combining.

Rows are combined three times: in their own task before anything is moved, per
(digest, salt) after one exchange, and per digest over the few salt winners.
Each time the normalised text itself is part of the grouping key, so two texts
are merged only if they are equal, never because their digests are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import SPACES, table


def normalised(text):
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _length(text_col: str):
    """Code points of the original text; null counts as empty."""
    return F.char_length(F.coalesce(F.col(text_col), F.lit("")))


def _salt(id_col: str, text_col: str, salts: int):
    """A row's part of its group: by id, and by the original's length for rows that share one."""
    return F.pmod(F.xxhash64(F.col(id_col), _length(text_col)), F.lit(salts)).cast("int")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256, keep_id, keep_length, group_size, salts`` (a bit for each that its rows have).

    ``salts`` (at most 63) bounds what one task sees of a single group: a text that makes up
    a third of all rows is first merged in ``salts`` parts, each of which is at
    most one row per map task thanks to the partial aggregation.
    """
    content = normalised(F.col(text_col))
    rows = docs.select(
        content.alias("content"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        # The smallest struct wins: more code points, then the smaller id; a row
        # without id only if there is no other.
        F.struct(
            (-_length(text_col)).alias("n"),
            F.col(id_col).isNull().alias("no_id"),
            F.col(id_col).alias("id"),
        ).alias("best"),
        _salt(id_col, text_col, salts).alias("salt"),
    )
    merged = rows.groupBy("digest", "salt", "content").agg(F.min("best").alias("best"), F.count("*").alias("n"))
    groups = merged.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    winners = groups.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_length"), F.col("n").alias("group_size"), "salts")
    # Members find their group by digest alone. That is safe only while a digest
    # has one content, so a collision stops the job instead of mixing two texts.
    return (
        winners.groupBy("digest")
        .agg(*[F.max(c).alias(c) for c in ("keep_id", "keep_length", "group_size", "salts")], F.count("*").alias("contents"))
        .select(
            F.lower(F.hex("digest")).alias("text_sha256"),
            "keep_id",
            "keep_length",
            "salts",
            F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
            .otherwise(F.col("group_size"))
            .alias("group_size"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """All columns of ``docs`` plus ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``; the row with the most code points stays, then the one
    with the smallest id. Null and empty texts form one group. Repeated rows
    (same id, and as many code points) count in ``group_size`` and cannot be
    told apart: if one stays, each is marked kept. Columns of ``docs`` with the
    names of the result columns are replaced. Rows meet their group by (digest,
    salt), of which the group has one row for every salt among its rows, so the
    rows of a hot text are in ``salts`` tasks here too.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    new = ("keep_id", "group_size", "kept", "text_sha256")
    base = docs.drop(*new)
    # Before the join, so that a caller who needs no text moves none.
    tagged = base.select("*", F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"), _salt(id_col, text_col, salts).alias("__salt"), _length(text_col).alias("__length"))
    by_salt = groups.withColumn("__salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (salts & shiftleft(1L, s)) <> 0)"))).select("text_sha256", "__salt", "keep_id", "keep_length", "group_size")
    joined = tagged.join(by_salt, ["text_sha256", "__salt"], "left")
    kept = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("__length") == F.col("keep_length"))
    return joined.select(*base.columns, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The columns of ``docs`` for one row of each group of equal texts: that which ``exact_dedup`` marks.

    Of rows with one id, as many code points and equal texts any one stays.
    Such rows are merged before they are moved, and what is left meets the
    groups where that merge put it, so a text is shuffled once here.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    # As text, so that null is a key like any other.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("__key")
    names = ["__digest", "__length", "__key"]
    tagged = docs.select("*", F.sha2(normalised(F.col(text_col)), 256).alias("__digest"), _length(text_col).alias("__length"), key(id_col))
    # `group_size` raises where two texts share a digest, so it is read here too.
    chosen = groups.filter("group_size > 0").select(F.col("text_sha256").alias("__digest"), F.col("keep_length").alias("__length"), key("keep_id"))
    return tagged.dropDuplicates(names).join(chosen, names, "left_semi").select(*docs.columns)


def op6_exact_dedup(spark, sf_dir):
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
with n as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as c from documents)
select doc_id,
       first_value(doc_id) over (partition by c order by length(t) desc, doc_id) as keep_id,
       count(*) over (partition by c) as group_size,
       doc_id = first_value(doc_id) over (partition by c order by length(t) desc, doc_id)
         and length(t) = max(length(t)) over (partition by c) as kept,
       sha256(c) as text_sha256
from n
"""
