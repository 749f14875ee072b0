"""Chat formatting by perspective rotation: the dialogue once per participant, who is the assistant in it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ingestlens.llm.common import stored, table

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Turns that one output row covers; longer dialogues go on in further parts.
PART_TURNS = 1000


def render_turn(role: str | None, text: str, perspective: str | None) -> tuple[str, str]:
    """Head and body of a turn; the body with its end marker is what is learned if the speaker is the perspective.

    Markers inside a text or a role are broken by a backslash and a role's line
    ends become spaces, so that neither can forge a turn.
    """
    text = text.replace("<|im_", "<\\|im_")
    if role == perspective:
        head = f"{BEGIN}assistant\n"
    elif role == "system":
        head = f"{BEGIN}system\n"
    elif role is None:
        head = f"{BEGIN}user\n"
    else:
        name = role.replace("\r", " ").replace("\n", " ").replace("<|im_", "<\\|im_")
        head = f"{BEGIN}user name={name}\n"
    return head, f"{text}{END}\n"


def numbered_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``nth``, their place from 0 in the dialogue.

    The rows are exchanged once, by ranges of (dialogue, turn, role, digest of
    the text, row), so a dialogue of any length, and any number of turns with
    one number, are spread over tasks. A task numbers its own rows; only
    dialogues that go on in a further task, at most one a task, need the count
    of the rows ahead.
    """
    keyed = rows.withColumn("digest", F.md5("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "tie")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("task"))
    names = ["conv_id", "turn", "role", "text", "task", "here"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                last, n = conv, n + 1 if conv == last else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema]
    numbered = stored(placed.mapInArrow(count, ", ".join([*fields, "here long"])), "numbered-turns")
    parts = numbered.groupBy("conv_id", "task").agg((F.max("here") + 1).alias("n"))
    before = W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.select(F.col("conv_id").alias("of"), F.col("task").alias("at"), F.sum("n").over(before).alias("ahead")).filter("ahead > 0")
    # At most one row a task: the dialogue that an earlier one began.
    joined = numbered.join(F.broadcast(ahead), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("task") == F.col("at")), "left")
    return joined.select("conv_id", "turn", "role", "text", (F.col("here") + F.coalesce("ahead", F.lit(0))).alias("nth"))


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS
) -> DataFrame:
    """``conv_id, perspective, part, n_turns, text, mask_spans, char_start``: a row per participant and part.

    Participants are the roles of a dialogue other than ``system``; a null role
    is a participant of its own without a name, a null text an empty turn, a
    null turn number comes first, a null conversation is one of its own. Equal
    turn numbers are put in order of role (null first) and MD5 of the text;
    repeated rows are repeated turns. A dialogue of only system turns has no
    participant and no row. Every part but a dialogue's last holds exactly
    ``part_turns`` turns, so no row grows with the dialogue; the texts of its
    parts, one after the other, are the whole rendering (:func:`whole_renderings`).
    ``mask_spans`` are [start, end) in characters of the part's text;
    ``char_start`` is where the part begins in the whole.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    numbered = numbered_turns(rows)
    parts = (
        numbered.withColumn("part", F.expr(f"nth div {part_turns}"))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text"))).alias("turns"))
    )
    speakers = numbered.select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct().filter("not perspective <=> 'system'")
    pairs = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for turns_, speaker in zip(batch.column("turns"), batch.column("perspective").to_pylist(), strict=True):
                pieces, masked, at = [], [], 0
                for t in turns_.as_py():
                    head, body = render_turn(t["role"], t["text"], speaker)
                    if t["role"] == speaker:
                        masked.append({"start": at + len(head), "end": at + len(head) + len(body)})
                    pieces += head, body
                    at += len(head) + len(body)
                texts.append("".join(pieces))
                spans.append(masked)
            sizes = [len(x) for x in batch.column("turns")]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("perspective"), batch.column("part"), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)],
                ["conv_id", "perspective", "part", "n_turns", "text", "mask_spans"],
            )

    kind = parts.schema["conv_id"].dataType.simpleString()
    rendered = pairs.mapInArrow(
        run, f"conv_id {kind}, perspective string, part long, n_turns long, text string, mask_spans array<struct<start:long,end:long>>"
    )
    # A window over parts only: one row for part_turns turns.
    before = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return rendered.withColumn("char_start", F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)))


def whole_renderings(rendered: DataFrame) -> DataFrame:
    """``conv_id, perspective, n_turns, text, mask_spans`` of whole dialogues, for those that are known to fit in a row."""
    moved = F.transform("mask_spans", lambda s: F.struct((s["start"] + F.col("char_start")).alias("start"), (s["end"] + F.col("char_start")).alias("end")))
    parts = F.sort_array(F.collect_list(F.struct("part", "text", moved.alias("spans"))))
    got = rendered.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), parts.alias("p"))
    texts, spans = F.transform("p", lambda x: x["text"]), F.flatten(F.transform("p", lambda x: x["spans"]))
    return got.select("conv_id", "perspective", "n_turns", F.array_join(texts, "").alias("text"), spans.alias("mask_spans"))


def op4_perspectives(spark, sf_dir):
    out = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return out.select("conv_id", "perspective", "part", "n_turns", "char_start", "text", F.array_join(spans, ",").alias("mask"))


OP4_SQL = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as raw, replace(coalesce(text, ''), '<|im_', '<\|im_') as body,
         (row_number() over (partition by conv_id order by turn nulls first, role nulls first, md5(coalesce(text, ''))) - 1) // 1000 as part
  from conversations),
p as (select distinct conv_id, role as perspective from t where role is distinct from 'system'),
r as (
  select t.conv_id, perspective, part, turn, role, raw,
         '<|im_start|>' || case when role is not distinct from perspective then 'assistant' when role = 'system' then 'system' when role is null then 'user'
           else 'user name=' || replace(replace(replace(role, chr(13), ' '), chr(10), ' '), '<|im_', '<\|im_') end || chr(10) as head,
         body || '<|im_end|>' || chr(10) as body
  from t join p on t.conv_id is not distinct from p.conv_id),
c as (
  select *, sum(length(head) + length(body)) over w - length(body) as s, sum(length(head) + length(body)) over w as e
  from r window w as (partition by conv_id, perspective, part order by turn nulls first, role nulls first, md5(raw) rows unbounded preceding)),
g as (
  select conv_id, perspective, part, count(*) as n_turns, string_agg(head || body, '' order by s) as text,
         coalesce(string_agg(case when role is not distinct from perspective then s::bigint || ':' || e::bigint end, ',' order by s), '') as mask
  from c group by all)
select conv_id, perspective, part, n_turns,
       cast(coalesce(sum(length(text)) over (partition by conv_id, perspective order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as char_start,
       text, mask
from g
"""
