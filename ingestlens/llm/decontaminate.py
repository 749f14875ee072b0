"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (a shorter item is one
window), a window into word shingles. The corpus is read once: of all its
shingles only those that some window has are kept, with the few words around
them. Their counts over the whole corpus give the rarity order. A window that
must be contained whole needs a prefix of one shingle, its rarest; each place
where that shingle stands gives one possible start, which the length and
positional bounds and the exact comparison of all the window's words decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.llm.common import lower_ascii, stored, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark shingles up to this number are broadcast (8 bytes each and a hash slot); of more, a Bloom filter is.
BROADCAST_ROWS = 500_000
#: Longs of that filter at most (8 MB): up to 4 million shingles it lets some 0.3 % of other words pass, beyond them more; the result is the same.
FILTER_LONGS = 1 << 20


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, in lower case; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def item_windows(items: DataFrame, item_id: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``item_id, w`` (the window's words), ``k`` (words in its shingles)."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = words.select("item_id", "words", F.explode(starts).alias("s"))
    return cut.select("item_id", F.slice("words", F.col("s") + 1, window).alias("w")).withColumn(
        "k", F.least(F.size("w"), F.lit(shingle))
    )


def _places(windows: DataFrame, shingle: int) -> DataFrame:
    """``w, k, offset, h``: every shingle of every distinct window."""
    offsets = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k")))
    rows = windows.select("w", "k").distinct().select("w", "k", offsets.alias("offset"))
    h = F.coalesce(*[F.when(F.col("k") == k, _shingle(F.col("w"), F.col("offset"), k)) for k in range(1, shingle + 1)])
    return rows.withColumn("h", h)


def _filter_bits(h: Column) -> Column:
    """The four bits that a hash sets in its long of the Bloom filter."""
    other = F.xxhash64(h)
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(other, 6 * j), F.lit(64)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def bloom_filter(wanted: DataFrame, n_wanted: int) -> tuple[Column, int]:
    """A Bloom filter of ``wanted`` (h) as an array of longs and their number, at most ``FILTER_LONGS``: a long for two shingles."""
    n = max(1, min(FILTER_LONGS, n_wanted // 2))
    none = wanted.sparkSession.range(n).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    some = wanted.select(F.pmod("h", F.lit(n)).alias("at"), _filter_bits(F.col("h")).alias("bits"))
    longs = stored(some.unionAll(none).groupBy("at").agg(F.bit_or("bits").alias("bits")), "bloom-filter")
    return longs.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"])).scalar(), n


def may_be_wanted(h: Column, bloom: tuple[Column, int]) -> Column:
    longs, n = bloom
    bits = _filter_bits(h)
    return F.get(longs, F.pmod(h, F.lit(n)).cast("int")).bitwiseAND(bits) == bits


def item_classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``w, class`` and ``class, item_id``: windows that stand in the same items are one class, so that many
    documents with one window of many items meet the window's class, not its items."""
    each = windows.select("w", F.col("item_id").cast("string").alias("item_id")).distinct()
    members = [F.bit_xor(F.xxhash64(F.lit(seed), "item_id")) for seed in (0, 1)]
    of = stored(each.groupBy("w").agg(F.struct(F.count("*").alias("n"), *[m.alias(f"x{i}") for i, m in enumerate(members)]).alias("class")), "item-classes")
    return of, of.groupBy("class").agg(F.min("w").alias("w")).join(each, "w").select("class", "item_id")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``text_hash, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies inside any occurrence of any window. Null and empty
    texts have no words and no hits; repeated rows are answered one by one;
    items without words have no windows; an empty ``items`` hits nothing, empty
    ``docs`` give no rows. A very long text is the work of one task, which only the
    words near a benchmark shingle leave. The columns are fixed, so further
    columns of ``docs`` and ``items`` cannot clash.
    ``items_sha256`` digests the ids of the items found, sorted as strings and
    joined by commas.
    """
    windows = stored(item_windows(items, item_id, item_text, window, shingle), "item-windows")
    places = _places(windows, shingle)
    wanted = places.select("h").distinct()
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect()) or [shingle]
    n_wanted = wanted.count()

    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        words_of(F.col(text_col)).alias("words"),
    )

    # Place -1 stands for the document itself, so that one reading gives both its word count and its hits.
    at = base.select("row", "id", "text_hash", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("pos"))
    hashes = [F.when(F.col("pos") >= 0, _shingle(F.col("words"), F.col("pos"), k)) for k in sizes]
    if len(hashes) == 1:
        hashed = at.withColumn("h", hashes[0])
    else:
        hashed = at.withColumn("h", F.explode(F.array(*hashes))).filter("pos >= 0 or h is null")
    around = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    is_doc = F.col("pos") < 0
    out = [
        "row",
        F.when(is_doc, F.col("id")).alias("id"),
        F.when(is_doc, F.col("text_hash")).alias("text_hash"),
        F.size("words").alias("n_words"),
        "pos",
        "h",
        F.when(~is_doc, around).alias("first"),
        F.when(~is_doc, F.slice("words", around + 1, 2 * window - 1)).alias("near"),
    ]
    if n_wanted <= BROADCAST_ROWS:
        marked = F.broadcast(wanted.withColumn("wanted", F.lit(True)))
        found = hashed.join(marked, "h", "left").filter(is_doc | F.col("wanted")).select(*out)
    else:  # what passes the filter wrongly meets no window below
        found = hashed.filter(is_doc | may_be_wanted(F.col("h"), bloom_filter(wanted, n_wanted))).select(*out)
    found = stored(found, "shingle-hits")
    heads = found.filter("pos < 0").dropDuplicates(["row"]).select("row", "id", "text_hash", "n_words")
    hits = found.filter("pos >= 0").select("row", "n_words", "pos", "h", "first", "near")

    # Rarity over all documents; the rarest shingle of a window is its whole prefix.
    counts = hits.groupBy("h").agg(F.count("*").alias("n"))
    prefix = (
        places.join(counts, "h", "left")
        .groupBy("w", "k")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("h"), F.col("offset"))).alias("p"))
        .filter("p.n > 0")
        .select("w", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))
    )
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("w") <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.size("w")) == F.col("w")
    occurs = stored(
        hits.join(prefix, "h").filter(fits).filter(same).select("row", start.alias("start"), "w").distinct(), "occurrences"
    )
    words_hit = (
        occurs.select("row", "start", F.size("w").alias("len")).distinct()
        .select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("word"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    # Documents with the same classes of windows have the same items, which are put together once for all of them.
    class_of, members = item_classes(windows)
    per_row = occurs.select("row", "w").distinct().join(class_of, "w").groupBy("row").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    per_row = stored(per_row.withColumn("same", F.sha2(F.to_json("classes"), 256)), "classes-hit")
    sets = per_row.groupBy("same").agg(F.first("classes").alias("classes"))
    found_items = sets.select("same", F.explode("classes").alias("class")).join(members, "class").select("same", "item_id").distinct()
    ids = F.array_join(F.sort_array(F.collect_list("item_id")), ",")
    digests = found_items.groupBy("same").agg(F.sha2(ids.cast("binary"), 256).alias("ids"), F.count("item_id").alias("n_items"))
    items_hit = per_row.select("row", "same").join(digests, "same").drop("same")
    return (
        heads.join(words_hit, "row", "left")
        .join(items_hit, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "text_hash",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("ids", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; their columns as they came.

    Rows are told apart by id and text together, so repeated ids with other
    texts are judged each on its own.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = find_contamination(docs, items, **options).filter("contaminated")
    bad = bad.select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(
        bad, docs[id_col].eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs[text_col]) == F.col("bad_hash")), "left_anti"
    )


def op8_decontaminate(spark, sf_dir):
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash")


OP8_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
iw as (
  select distinct item_id, array_to_string(w[s + 1 : s + 10], ' ') as t, len(w[s + 1 : s + 10]) as n
  from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from i where len(w) > 0)),
dw as (
  select r, s, n, array_to_string(w[s + 1 : s + n], ' ') as t
  from (select r, w, n, unnest(range(0, len(w) - n + 1)) as s from d, (select distinct n from iw) where len(w) >= n)),
hit as (select dw.r, dw.s, dw.n, iw.item_id from dw join iw using (t, n)),
words as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from (select distinct r, s, n from hit)) group by r),
items as (
  select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (r) left join items using (r)
"""
