"""Quality rules: counts per text, and a likelihood ratio of hashed n-grams between trusted rows and the whole corpus.

Two multinomials over hashed words and word pairs are counted in one pass: one
of all rows, one of trusted rows. A text's score is the mean logarithm of their
ratio over its n-grams, in whole millionths, so that no order of summing changes
a verdict. It passes unless it is an outlier on the low side of the scores that
those trusted rows have which were kept out of the counting.

Texts are read once: counts and a number of two bytes a word are stored, and
counting and scoring read those. The trusted ids meet these rows, never the
texts, in one sort-merge join whatever the sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import SPACES, stored, table

_SPACE = r"[\\x20\\x09-\\x0D]"
#: n-grams fall into so many buckets: what is broadcast and collected per task, whatever the corpus. A word's code is two bytes.
BUCKETS = 1 << 16
#: Counts that every bucket has beforehand, in both multinomials.
PRIOR = 1.0
#: Of the trusted rows, one in so many is kept for the threshold.
HELD = 3
#: The threshold lies so many interquartile ranges of the kept trusted rows' scores below their lower quartile.
FENCE = 3
MILLION = 1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Ratio:
    """``weights`` (bucket, weight in millionths) and the least score that passes (None: all texts do)."""

    weights: DataFrame
    threshold: int | None


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``__words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``; a null text has no words.

    ``n_repeat_words`` are words in any window of three that the text has
    twice or more. Windows are sorted as numbers, 33 bits of a hash before 31
    of the place; those that share a hash with another are compared as texts,
    sorted so that equal ones stand together, and their places are swept once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = docs.withColumns(
        {
            "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE.replace("\\\\", "\\") + "+")),
            "__lines": F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(SPACES)) != ""),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    keys = "transform(sequence(0, size(__words) - 3), i -> shiftleft(xxhash64(__words[i], __words[i + 1], __words[i + 2]), 31) + i)"
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__keys": F.expr(f"case when size(__words) >= 3 then sort_array({keys}) else array() end"),
        }
    )
    alike = " or ".join(f"shiftright(x, 31) <=> shiftright(get(__keys, k {side} 1), 31)" for side in "-+")
    places = f"transform(filter(__keys, (x, k) -> {alike}), x -> cast(x & 2147483647L as int))"
    windows = f"transform({places}, i -> struct(concat_ws(' ', __words[i], __words[i + 1], __words[i + 2]) as w, i as i))"
    rows = rows.withColumn("__sorted", F.expr(f"sort_array({windows})"))
    repeated = "sort_array(transform(filter(__sorted, (x, k) -> x.w <=> get(__sorted, k - 1).w or x.w <=> get(__sorted, k + 1).w), x -> x.i))"
    covered = f"aggregate({repeated}, named_struct('p', -3, 'n', 0L), (a, i) -> named_struct('p', i, 'n', a.n + least(3, i - a.p)), a -> a.n)"
    return rows.withColumn("n_repeat_words", F.expr(covered)).drop("__lines", "__keys", "__sorted")


def base_failed() -> Column:
    """The fixed rules: under 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, the counts of :func:`with_counts`, and ``__codes``: of each word bytes three and four of its MD5, less 32,768."""
    rows = with_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    code = "transform(__words, w -> cast(cast(conv(substring(md5(cast(w as binary)), 5, 4), 16, 10) as int) - 32768 as smallint))"
    return rows.select("doc_id", *COUNTS, F.expr(code).alias("__codes"))


def _marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows`` plus ``held`` (null: not trusted).

    The join is the same at every size, so what it shuffles grows with the
    input. Rows without id meet nothing and are dealt over all tasks.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    left = rows.withColumn("__key", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(key))
    right = trusted.select(F.col("id").alias("doc_id"), "held").withColumn("__key", key)
    return left.join(right.hint("merge"), ["__key", "doc_id"], "left").select(*rows.columns, "held")


def _ngrams(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and a row per word with its bucket ``one`` and that of the pair it begins, ``two`` (null for the last)."""
    after = rows.withColumn("__after", F.expr("slice(__codes, 2, greatest(size(__codes), 1))"))
    pairs = after.select(*keep, F.explode_outer(F.arrays_zip("__codes", "__after")).alias("__g"))
    a, b = F.col("__g")["__codes"].cast("long") + 32768, F.col("__g")["__after"].cast("long") + 32768
    return pairs.select(*keep, a.alias("one"), F.pmod(a * 1_000_003 + b, F.lit(BUCKETS)).alias("two"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``id, held`` of the trusted rows: labelled 1, without id not; all of them."""
    ids = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id"), F.md5(F.col(id_col).cast("string").cast("binary")).alias("h")).filter("h is not null").distinct()
    held = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(HELD)) == 0
    return ids.select("id", held.alias("held"))


def scored(rows: DataFrame, weights: DataFrame, *keep: str) -> DataFrame:
    """``keep`` of each row and ``score``: the mean weight of its n-grams in millionths, rounded down; null without words.

    A row's n-grams are met with the weights and summed up in the task that read
    it; only ``keep`` and a sum are shuffled.
    """
    grams = _ngrams(rows.withColumn("__row", F.monotonically_increasing_id()), "__row", *keep)
    w = F.broadcast(weights)
    one, two = w.select(F.col("bucket").alias("one"), F.col("weight").alias("w1")), w.select(F.col("bucket").alias("two"), F.col("weight").alias("w2"))
    met = grams.join(one, "one", "left").join(two, "two", "left")
    sums = met.groupBy("__row", *keep).agg(F.sum(F.coalesce("w1", F.lit(0)) + F.coalesce("w2", F.lit(0))).alias("s"), (F.count("one") + F.count("two")).alias("n"))
    return sums.select(*keep, F.when(F.col("n") > 0, F.floor(F.col("s") / F.col("n"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """The ratio of trusted rows to all ``docs``; every row and its whole text are counted.

    Without trusted rows, or with too few to keep any for the threshold, all
    texts pass that the fixed rules let pass.
    """
    return _ratio(_read(docs, labels, id_col, text_col))


def judge(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts of :func:`with_counts`, ``base_failed, score, kept`` for every row of ``docs``.

    ``score`` is null for a text without words. Repeated rows are judged each
    for itself, a null id is an id like others, an empty table gives an empty
    result, and other columns are ignored, whatever their names. A text is
    handled as a whole in one row, so memory is bounded by the longest text.
    """
    return _judged(_coded(docs, id_col, text_col), ratio)


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`judge` of ``docs`` by the ratio that :func:`fit` finds in them; texts are read once for both."""
    rows = _read(docs, labels, id_col, text_col)
    return _judged(rows, _ratio(rows))


def _read(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stored(_marked(_coded(docs, id_col, text_col), trusted_ids(labels)), "coded-texts")


def _ratio(rows: DataFrame) -> Ratio:
    both = _ngrams(rows, "held").select("held", F.explode(F.array("one", "two")).alias("bucket")).filter("bucket is not null")
    counted = both.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(F.col("held") == False).alias("good"))  # noqa: E712
    counts = stored(counted, "bucket-counts")
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = lambda c, n: (F.col(c) + PRIOR) / (n + PRIOR * BUCKETS)
    weight = F.round(F.log(share("good", totals["good"]) / share("raw", totals["raw"])) * MILLION).cast("long")
    weights = counts.select("bucket", weight.alias("weight"))
    passing = scored(rows.filter("held").filter(~base_failed()), weights)
    low, high = passing.agg(*[F.expr(f"percentile_disc({q}) within group (order by score)") for q in (0.25, 0.75)]).first()
    return Ratio(weights, None if low is None or not totals["good"] else int(low - FENCE * (high - low)))


def _judged(rows: DataFrame, ratio: Ratio) -> DataFrame:
    out = scored(rows, ratio.weights, "doc_id", *COUNTS).withColumn("base_failed", base_failed())
    passes = F.lit(True) if ratio.threshold is None else F.col("score") >= ratio.threshold
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(passes, F.lit(False))).select("doc_id", *COUNTS, "base_failed", "score", "kept")


def op12_ngram_rules(spark, sf_dir):
    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = (
    r"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
w as (select id, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
tok as (select id, doc_id, unnest(ws) x, unnest(range(len(ws))) i from w),
win as (select id, i, x || ' ' || lead(x) over o || ' ' || lead(x, 2) over o g from tok window o as (partition by id order by i)),
rep as (select id, i from (select *, count(*) over (partition by id, g) n from win where g is not null) where n > 1),
cov as (select id, count(distinct p) n from (select id, unnest([i, i + 1, i + 2]) p from rep) group by 1),
base as (
  select w.id, doc_id, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(cov.n, 0) n_repeat_words
  from w left join cov using (id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base),
code as (select id, doc_id, i, ('0x' || substr(md5(x), 1, 8))::bigint c from tok),
pair as (select id, doc_id, c, lead(c) over (partition by id order by i) e from code),
gram as (select id, doc_id, c % 65536 bucket from pair union all select id, doc_id, (c * 1000003 + e) % 65536 from pair where e is not null),
trusted as (select doc_id, ('0x' || substr(h, 1, 8))::bigint % 3 = 0 held from (select distinct doc_id, md5(doc_id::varchar) h from labels where quality = 1 and doc_id is not null) order by h limit 50000),
cnt as (select bucket, count(*) r, count(*) filter (where held = false) g from gram left join trusted using (doc_id) group by 1),
wt as (select bucket, round(ln(((g + 1) / (sum(g) over () + 65536)) / ((r + 1) / (sum(r) over () + 65536))) * 1000000)::bigint weight from cnt),
s as (select id, floor(sum(weight) / count(*))::bigint score from gram join wt using (bucket) group by 1),
low as (select quantile_disc(score, 0.25) - 3 * (quantile_disc(score, 0.75) - quantile_disc(score, 0.25)) least from b join s using (id) join trusted using (doc_id) where held and not base_failed)
select b.doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
       base_failed, score, not base_failed and coalesce(score >= least or least is null, false) kept
from b left join s using (id) cross join low
"""
)
