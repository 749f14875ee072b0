"""Validation (valid and rejected rows) and integrity audits (violations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ingestlens.functions import scalars as S
from ingestlens.operators.joins import account_drift, eligible_sites, foreign_errors
from ingestlens.schemas import (
    FAILED,
    FILES_PER_BATCH,
    IN_PROGRESS,
    MAX_FILE_BYTES,
    METADATA_BYTES,
    METADATA_ENTRIES,
    METADATA_KEY_LENGTH,
    STATUSES,
    TERMINAL,
)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).rlike(r"^\s*$")


def _longer(c: str, n: int) -> Column:
    return F.length(c) > n


def metadata_reason(c: str = "metadata") -> Column:
    """VAL7: the first broken rule, or null. Null and ``{}`` pass; a repeated key is not accepted as JSON.

    The size is that of the compact JSON in UTF-8 bytes.
    """
    m = F.col(c)
    parsed = F.try_parse_json(m)
    keys = F.json_object_keys(m)
    return (
        F.when(m.isNull(), None)
        .when(parsed.isNull() | keys.isNull(), F.lit("METADATA_INVALID"))
        .when(F.size(keys) > METADATA_ENTRIES, F.lit("METADATA_ENTRIES"))
        .when(F.exists(keys, lambda k: k == ""), F.lit("METADATA_EMPTY_KEY"))
        .when(F.exists(keys, lambda k: F.length(k) > METADATA_KEY_LENGTH), F.lit("METADATA_KEY_LENGTH"))
        .when(F.octet_length(F.to_json(parsed)) > METADATA_BYTES, F.lit("METADATA_SIZE"))
    )




def rules(table: str) -> list[tuple[str, Column]]:
    """VAL1: ``(code, is broken)`` for a table's rows; built on demand because columns need a session."""
    known = {
        "accounts": lambda: [
            ("EMAIL_BLANK", _blank("email")),
            ("EMAIL_FORMAT", ~_blank("email") & ~S.is_email("email")),
            ("EMAIL_LENGTH", _longer("email", 255)),
            ("NAME_BLANK", _blank("name")),
            ("NAME_LENGTH", ~_blank("name") & ~F.length("name").between(2, 100)),
        ],
        "sites": lambda: [
            ("ACCOUNT_MISSING", F.col("account_id").isNull()),
            ("DOMAIN_BLANK", _blank("domain")),
            ("DOMAIN_FORMAT", ~_blank("domain") & ~S.is_domain("domain")),
            ("DISPLAY_NAME_BLANK", _blank("display_name")),
            ("DISPLAY_NAME_LENGTH", ~_blank("display_name") & ~F.length("display_name").between(2, 100)),
        ],
        "batches": lambda: [
            ("SITE_MISSING", F.col("site_id").isNull()),
            ("STATUS_UNKNOWN", F.col("status").isNull() | ~F.col("status").isin(*STATUSES)),
            ("COUNT_NEGATIVE", F.col("uploaded_files_count") < 0),
            ("SIZE_NEGATIVE", F.col("total_size") < 0),
            ("START_MISSING", F.col("started_at").isNull()),
        ],
        "uploaded_files": lambda: [
            ("BATCH_MISSING", F.col("batch_id").isNull()),
            ("NAME_BLANK", _blank("original_file_name")),
            ("SIZE_NOT_POSITIVE", F.col("file_size").isNull() | (F.col("file_size") <= 0)),
            ("SIZE_TOO_LARGE", F.col("file_size") > MAX_FILE_BYTES),
            ("CHECKSUM_FORMAT", F.col("checksum").isNull() | ~S.is_hex("checksum")),
        ],
        "error_logs": lambda: [
            ("SITE_MISSING", F.col("site_id").isNull()),
            ("TYPE_BLANK", _blank("type")),
            ("TYPE_LENGTH", _longer("type", 100)),
            ("MESSAGE_BLANK", _blank("message")),
            ("MESSAGE_LENGTH", _longer("message", 1000)),
            ("TIME_MISSING", F.col("occurred_at").isNull()),
        ],
    }
    return known[table]()


def with_reasons(df: DataFrame, table: str) -> DataFrame:
    """VAL1: ``df`` with the codes of broken rules in the order of the rules; for errors also VAL7's."""
    codes = [F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules(table)]
    if table == "error_logs" and "metadata" in df.columns:
        codes.append(metadata_reason())
    return df.withColumn("reasons", F.array_compact(F.array(*codes)))


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """VAL1: valid rows, and rejected rows with ``reasons``."""
    judged = with_reasons(df, table)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


#: VAL2: the columns that identify a row, and whether their case counts.
UNIQUE = {
    "accounts": (["email"], False),
    "sites": (["domain"], False),
    "s3_keys": (["s3_key"], True),
    "uploaded_files": (["batch_id", "original_file_name"], True),
    "error_logs": (["error_id", "occurred_at"], True),
}


def duplicates(df: DataFrame, rule: str) -> DataFrame:
    """VAL2: keys held by several rows, with their number; nulls are no keys."""
    columns, exact = UNIQUE[rule]
    keys = [F.col(c).alias(c) if exact else F.lower(c).alias(c) for c in columns]
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def several_open(batches: DataFrame) -> DataFrame:
    """VAL3: sites with more than one open batch."""
    return batches.filter(F.col("status") == IN_PROGRESS).groupBy("site_id").agg(F.count("*").alias("n")).filter("n > 1")


def _nth(key: str = "file_id") -> Column:
    nameless = F.col("batch_id").isNull() | F.col("original_file_name").isNull()
    # Rows without a name are dealt by their key, or all of them would be one group.
    order = W.partitionBy("batch_id", "original_file_name", F.when(nameless, F.xxhash64(key))).orderBy("uploaded_at", key)
    return F.when(nameless, 1).otherwise(F.row_number().over(order))


def first_uploads(files: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """VAL4: the first file of each name in a batch, and the later ones; without a name or batch none is a later one."""
    numbered = files.withColumn("_nth", _nth(key))
    return numbered.filter("_nth = 1").drop("_nth"), numbered.filter("_nth > 1").drop("_nth")


def admission(files: DataFrame, batches: DataFrame, key: str = "file_id") -> DataFrame:
    """VAL5: files with the ``reason`` of the first rule that keeps them out, null if admitted.

    In order: empty file, unknown batch, batch not open, too large, no name, and
    a name that an earlier admissible file of the batch has.
    """
    joined = files.join(batches.select("batch_id", F.col("status").alias("_status")), "batch_id", "left")
    reason = (
        F.when(F.coalesce(F.col("file_size"), F.lit(0)) <= 0, F.lit("EMPTY_FILE"))
        .when(F.col("_status").isNull(), F.lit("BATCH_NOT_FOUND"))
        .when(F.col("_status") != IN_PROGRESS, F.lit("BATCH_NOT_OPEN"))
        .when(F.col("file_size") > MAX_FILE_BYTES, F.lit("TOO_LARGE"))
        .when(_blank("original_file_name"), F.lit("NAME_BLANK"))
    )
    judged = joined.withColumn("reason", reason)
    # Files that are kept out already have no order among them and are dealt by their key.
    order = W.partitionBy("batch_id", "original_file_name", F.when(F.col("reason").isNotNull(), F.xxhash64(key))).orderBy("uploaded_at", key)
    later = F.col("reason").isNull() & (F.row_number().over(order) > 1)
    return judged.withColumn("reason", F.when(later, F.lit("DUPLICATE_NAME")).otherwise(F.col("reason"))).drop("_status")


def over_quota(files: DataFrame, limit: int = FILES_PER_BATCH) -> DataFrame:
    """VAL6."""
    return files.groupBy("batch_id").agg(F.count("*").alias("files")).filter(F.col("files") > limit)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """VAL8: rows whose (not null) key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


#: VAL8: each table's own key and the keys by which its rows name others, all as (kind of key, column, name of the reference).
REFERENCES = {
    "accounts": [("account", "account_id", None)],
    "sites": [("site", "site_id", None), ("account", "account_id", "site.account")],
    "batches": [("batch", "batch_id", None), ("site", "site_id", "batch.site"), ("account", "account_id", "batch.account")],
    "files": [("batch", "batch_id", "file.batch")],
    "errors": [("site", "site_id", "error.site"), ("batch", "batch_id", "error.batch")],
}


def referential_report(accounts: DataFrame, sites: DataFrame, batches: DataFrame, files: DataFrame, errors: DataFrame) -> DataFrame:
    """VAL8: ``reference, violations`` of every reference, from one scan of each table and one shuffle.

    Owners and references of a key meet in one aggregation: a bit says which of
    them it has seen (0: its owner), and a map-side count per (key, reference)
    makes a frequent key a row a task. Keys are compared as text; null refers to nothing.
    """
    names = [name for keys in REFERENCES.values() for _, _, name in keys if name]
    tagged = None
    for table, rows in zip(REFERENCES, (accounts, sites, batches, files, errors), strict=True):
        keys = [
            F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"), F.lit(names.index(name) + 1 if name else 0).alias("role"))
            for kind, c, name in REFERENCES[table]
        ]
        own = rows.select(F.explode(F.array(*keys)).alias("k")).select("k.*").filter("key is not null")
        tagged = own if tagged is None else tagged.unionByName(own)
    counts = [F.count_if(F.col("role") == i + 1).alias(f"n{i}") for i in range(len(names))]
    met = tagged.groupBy("kind", "key").agg(F.bit_or(F.when(F.col("role") == 0, 1).otherwise(0)).alias("owned"), *counts)
    lost = met.agg(*[F.coalesce(F.sum(F.when(F.col("owned") == 0, F.col(f"n{i}"))), F.lit(0)).alias(f"n{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(name).alias("reference"), F.col(f"n{i}").alias("violations")) for i, name in enumerate(names)])
    return lost.select(F.explode(rows).alias("r")).select("r.*")


def storage_difference(files: DataFrame, stored: DataFrame) -> DataFrame:
    """VAL9: ``s3_key, kind``: ORPHAN_OBJECT, MISSING_OBJECT, SIZE_MISMATCH or DIGEST_MISMATCH.

    ``stored`` has ``s3_key, stored_size`` and may have ``stored_checksum``.
    """
    digests = "stored_checksum" in stored.columns
    listed = files.select("s3_key", "file_size", *(["checksum"] if digests else []), F.lit(True).alias("_listed"))
    there = stored.select("s3_key", "stored_size", *(["stored_checksum"] if digests else []), F.lit(True).alias("_there"))
    kinds = [
        F.when(F.col("_listed").isNull(), F.lit("ORPHAN_OBJECT")),
        F.when(F.col("_there").isNull(), F.lit("MISSING_OBJECT")),
        F.when(F.col("file_size") != F.col("stored_size"), F.lit("SIZE_MISMATCH")),
    ]
    if digests:
        kinds.append(F.when(F.col("_listed") & F.col("_there") & ~S.same_digest("checksum", "stored_checksum"), F.lit("DIGEST_MISMATCH")))
    return listed.join(there, "s3_key", "full").select("s3_key", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def tenancy_audit(accounts: DataFrame, sites: DataFrame, batches: DataFrame, errors: DataFrame) -> DataFrame:
    """VAL10: ``kind, id``: errors on another site's batch, active sites of inactive accounts, batches of sites that may not send, drifted accounts."""
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    may = eligible_sites(sites, accounts).select("site_id")
    return (
        row(foreign_errors(errors, batches), "FOREIGN_ERROR", "error_id")
        .unionByName(row(sites.filter("is_active").join(accounts.filter("is_active").select("account_id"), "account_id", "left_anti"), "ACTIVE_SITE_INACTIVE_ACCOUNT", "site_id"))
        .unionByName(row(batches.join(may, "site_id", "left_anti"), "BATCH_OF_INELIGIBLE_SITE", "batch_id"))
        .unionByName(row(account_drift(batches, sites), "ACCOUNT_DRIFT", "batch_id"))
    )


def content_duplicates(files: DataFrame, batches: DataFrame) -> DataFrame:
    """VAL11: digests of several files, with the numbers of files, batches and sites.

    Counted by (digest, batch), then by (digest, site), then by digest: each step
    is combined before it is moved, so a digest of very many files is a few rows.
    """
    joined = files.join(batches.select("batch_id", "site_id"), "batch_id").withColumn("checksum", F.lower("checksum"))
    per_batch = joined.groupBy("checksum", "site_id", "batch_id").agg(F.count("*").alias("files"))
    per_site = per_batch.groupBy("checksum", "site_id").agg(F.sum("files").alias("files"), F.count("*").alias("batches"))
    whole = per_site.groupBy("checksum").agg(F.sum("files").alias("files"), F.sum("batches").alias("batches"), F.count("site_id").alias("sites"))
    return whole.filter("files > 1")


def incoherent(batches: DataFrame) -> DataFrame:
    """VAL12: batches whose status, times and error flag do not fit together, with ``reasons``."""
    ended = F.col("status").isin(*TERMINAL)
    checks = [
        ("ENDED_WITHOUT_TIME", ended & F.col("completed_at").isNull()),
        ("OPEN_WITH_TIME", ~ended & F.col("completed_at").isNotNull()),
        ("FAILED_WITHOUT_ERRORS", (F.col("status") == FAILED) & ~F.col("has_errors")),
        ("ENDED_BEFORE_START", F.col("completed_at") < F.col("started_at")),
    ]
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in checks]))
    return batches.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
