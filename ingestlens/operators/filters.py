"""Filters and lookups. Only predicates that are given are built, so that all of them reach the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S
from ingestlens.schemas import IN_PROGRESS, STATUSES, TERMINAL, TIMEOUT_MINUTES


def newest_first(df: DataFrame, time: str, key: str) -> DataFrame:
    """Sorted by time descending; the key breaks ties, so pages are stable."""
    return df.orderBy(F.col(time).desc(), F.col(key).desc())


def by_id(df: DataFrame, key: str, value, **also) -> DataFrame:
    """FIL1: the row with this id (and, for a file, of the right batch)."""
    for name, expected in {key: value, **also}.items():
        df = df.filter(F.col(name) == F.lit(expected))
    return df


def by_ids(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """FIL1 for many ids: a semi join instead of a list."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def by_text(df: DataFrame, column: str, value: str) -> DataFrame:
    """FIL2: account by e-mail, site by domain, whatever the case."""
    return df.filter(F.lower(column) == F.lower(F.lit(value)))


def existing(candidates: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """FIL3: the candidates whose e-mail or domain is in use, whatever the case."""
    used = df.select(F.lower(column).alias("_used")).distinct()
    return candidates.join(used, F.lower(candidates[column]) == F.col("_used"), "left_semi")


def active_accounts(accounts: DataFrame) -> DataFrame:
    """FIL4."""
    return newest_first(accounts.filter("is_active"), "created_at", "account_id")


def sites_of(sites: DataFrame, account=None, active_only: bool = False) -> DataFrame:
    """FIL5."""
    if account is not None:
        sites = sites.filter(F.col("account_id") == F.lit(account))
    if active_only:
        sites = sites.filter("is_active")
    return newest_first(sites, "created_at", "site_id")


def open_batches(batches: DataFrame, site=None) -> DataFrame:
    """FIL6: the active batch of a site, or of every site."""
    batches = batches.filter(F.col("status") == IN_PROGRESS)
    return batches if site is None else batches.filter(F.col("site_id") == F.lit(site))


def expired(batches: DataFrame, as_of: datetime, minutes: int = TIMEOUT_MINUTES) -> DataFrame:
    """FIL7: open and started strictly before the cutoff."""
    return open_batches(batches).filter(F.col("started_at") < S.cutoff(F.lit(as_of).cast("timestamp_ntz"), minutes))


def batch_list(batches: DataFrame, site=None, status: str | None = None) -> DataFrame:
    """FIL8: newest first; an unknown status is an error."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    if site is not None:
        batches = batches.filter(F.col("site_id") == F.lit(site))
    if status is not None:
        batches = batches.filter(F.col("status") == status)
    return newest_first(batches, "started_at", "batch_id")


def in_range(errors: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """FIL10: ``[start, end)``; where the table is partitioned by month the months are restricted too, so that others are not listed."""
    months = "ym" in errors.columns
    if start is not None:
        errors = errors.filter(F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz"))
        if months:
            errors = errors.filter(F.col("ym") >= start.strftime("%Y_%m"))
    if end is not None:
        errors = errors.filter(F.col("occurred_at") < F.lit(end).cast("timestamp_ntz"))
        if months:
            errors = errors.filter(F.col("ym") <= end.strftime("%Y_%m"))
    return errors


def error_filter(errors: DataFrame, site=None, type_: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """FIL11: each predicate is optional."""
    if site is not None:
        errors = errors.filter(F.col("site_id") == F.lit(site))
    if type_ is not None:
        errors = errors.filter(F.col("type") == type_)
    return in_range(errors, start, end)


def error_list(errors: DataFrame, **predicates) -> DataFrame:
    """FIL9: FIL11's predicates, newest first."""
    return newest_first(error_filter(errors, **predicates), "occurred_at", "error_id")


def errors_of(errors: DataFrame, key: str, value) -> DataFrame:
    """FIL12: of a batch or a site, newest first."""
    return newest_first(errors.filter(F.col(key) == F.lit(value)), "occurred_at", "error_id")


def files_of(files: DataFrame, batch) -> DataFrame:
    """FIL13: oldest first."""
    return files.filter(F.col("batch_id") == F.lit(batch)).orderBy("uploaded_at", "file_id")


def already_uploaded(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """FIL14: candidates whose name, in this case, is in the batch."""
    return candidates.join(files.select("batch_id", "original_file_name").distinct(), ["batch_id", "original_file_name"], "left_semi")


def in_scope(df: DataFrame, scope: DataFrame, key: str = "site_id") -> DataFrame:
    """FIL15: rows owned by the caller's sites or accounts; for errors always by the error's own site."""
    return df.join(scope.select(key).distinct(), key, "left_semi")


def accepts_upload(status: Column | str = "status") -> Column:
    """FIL16."""
    return (F.col(status) if isinstance(status, str) else status) == IN_PROGRESS


def is_terminal(status: Column | str = "status") -> Column:
    """FIL16."""
    return (F.col(status) if isinstance(status, str) else status).isin(*TERMINAL)


def metadata_is(errors: DataFrame, path: str, value, kind: str = "string", column: str = "metadata") -> DataFrame:
    """FIL17: a value inside the metadata; rows without it or with broken JSON do not match.

    On a variant ``column``, as SNK4 stores it, the field alone is read and the
    predicate goes to the scan; on text every row is parsed.
    """
    whole = F.col(column) if errors.schema[column].dataType.typeName() == "variant" else F.try_parse_json(column)
    return errors.filter(F.try_variant_get(whole, path, kind) == F.lit(value))
