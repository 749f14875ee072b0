"""Pages with a total order: the key always ends the sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestlens.operators.stats import page_totals

#: Names that sort strings may use for columns.
ALIASES = {"createdAt": "created_at", "updatedAt": "updated_at", "startedAt": "started_at", "occurredAt": "occurred_at", "displayName": "display_name", "isActive": "is_active"}


def parse_sort(sort: str, columns: list[str]) -> tuple[str, bool]:
    """Column and whether it ascends: ``field,dir``; anything but ``asc`` descends, an unknown field is an error."""
    field, *way = sort.split(",")
    column = ALIASES.get(field, field)
    if column not in columns:
        raise ValueError(f"unknown sort field {field}")
    return column, bool(way) and way[0].lower() == "asc"


def _order(column: str, ascending: bool, key: str) -> list:
    return [getattr(F.col(c), "asc" if ascending else "desc")() for c in dict.fromkeys((column, key))]


def page(df: DataFrame, key: str, number: int = 0, size: int = 20, sort: str = "createdAt,desc") -> DataFrame:
    """PAG1: page ``number`` from 0. For deep pages use :func:`page_after` or :func:`ranked_page`."""
    if number < 0 or size <= 0:
        raise ValueError("page must not be negative and size must be positive")
    column, ascending = parse_sort(sort, df.columns)
    return df.orderBy(*_order(column, ascending, key)).offset(number * size).limit(size)


def batch_page(batches: DataFrame, number: int = 0, size: int = 20) -> DataFrame:
    """PAG2: by start, newest first."""
    return page(batches, "batch_id", number, size, "started_at,desc")


def error_page(errors: DataFrame, number: int = 0, size: int = 20) -> DataFrame:
    """PAG2: by occurrence, newest first."""
    return page(errors, "error_id", number, size, "occurred_at,desc")


def envelope(df: DataFrame, key: str, number: int = 0, size: int = 20, sort: str = "createdAt,desc") -> DataFrame:
    """PAG3: the page's rows, each with page, size and totals (a single row, cross joined)."""
    head = page_totals(df, size).select(F.lit(number).alias("page"), F.lit(size).alias("size"), "total_elements", "total_pages")
    return page(df, key, number, size, sort).crossJoin(head)


def page_after(df: DataFrame, key: str, after: tuple | None = None, size: int = 20, sort: str = "createdAt,desc") -> DataFrame:
    """PAG4: the rows after (sort value, key); its cost does not depend on the depth."""
    column, ascending = parse_sort(sort, df.columns)
    if after is not None:
        here, last = F.struct(column, key), F.struct(F.lit(after[0]).cast(df.schema[column].dataType).alias(column), F.lit(after[1]).cast(df.schema[key].dataType).alias(key))
        df = df.filter(here > last if ascending else here < last)
    return df.orderBy(*_order(column, ascending, key)).limit(size)


def build_rank_index(df: DataFrame, key: str, path: str, sort: str = "createdAt,desc") -> None:
    """The rows of ``df`` stored by ranges of the sort order, for :func:`ranked_page`: ``rows``, and the ``counts`` of every range.

    A range is what one task of the sort holds. The counts are one row a range.
    """
    column, ascending = parse_sort(sort, df.columns)
    order = _order(column, ascending, key)
    placed = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed.sortWithinPartitions("_range", *order).write.partitionBy("_range").parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/schema")
    stored = _indexed_rows(df.sparkSession, path)
    counts = stored.groupBy("_range").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")


def _indexed_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema.add("_range", T.IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def ranked_page(spark: SparkSession, path: str, key: str, number: int = 0, size: int = 20, sort: str = "createdAt,desc", totals: bool = False) -> DataFrame:
    """PAG1 and, with ``totals``, PAG3 from :func:`build_rank_index` (same ``key`` and ``sort``): any page reads only the ranges that hold it.

    The counts come to the driver, one number a range; rows are numbered within
    each of the one or two ranges (more if ``size`` is larger than a range).
    """
    if number < 0 or size <= 0:
        raise ValueError("page must not be negative and size must be positive")
    counts = {r["_range"]: r["n"] for r in spark.read.parquet(f"{path}/counts").collect()}
    first, ahead, wanted, starts = number * size, 0, [], {}
    for r in sorted(counts):
        if ahead < first + size and ahead + counts[r] > first:
            wanted.append(r)
            starts[r] = ahead
        ahead += counts[r]
    stored = _indexed_rows(spark, path)
    columns = [c for c in stored.columns if c != "_range"]
    column, ascending = parse_sort(sort, columns)
    rows = stored.filter(F.col("_range").isin(wanted)) if wanted else stored.limit(0)
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_range")] if starts else F.lit(0)
    nth = F.row_number().over(W.partitionBy("_range").orderBy(*_order(column, ascending, key))) - 1 + start
    page_ = rows.withColumn("_nth", nth).filter((F.col("_nth") >= first) & (F.col("_nth") < first + size)).orderBy("_nth").select(*columns)
    if not totals:
        return page_
    head = {"page": number, "size": size, "total_elements": ahead, "total_pages": -(-ahead // size)}
    return page_.withColumns({n: F.lit(v).cast("int" if n in ("page", "size") else "long") for n, v in head.items()})


def latest_batches(batches: DataFrame) -> DataFrame:
    """PAG5: the newest batch of every site."""
    row = F.struct(*batches.columns)
    best = batches.groupBy("site_id").agg(F.max_by(row, F.struct("started_at", "batch_id")).alias("_row"))
    return best.select("_row.*")
