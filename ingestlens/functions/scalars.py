"""Scalar functions: columns in, columns out, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms of e-mail addresses, domains and digests.
EMAIL_PATTERN = r"^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
DOMAIN_PATTERN = r"^[a-z0-9.-]+$"
HEX_PATTERN = r"^[0-9a-fA-F]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """SCA1: without leading and trailing blanks and control characters."""
    return F.regexp_replace(_c(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalised(c: Column | str) -> Column:
    """SCA1: an e-mail address or domain in lower case, trimmed."""
    return F.lower(trimmed(c))


def is_email(c: Column | str) -> Column:
    """SCA2: on the address as given, before normalising."""
    return _c(c).rlike(EMAIL_PATTERN)


def is_domain(c: Column | str) -> Column:
    """SCA3."""
    return _c(c).rlike(DOMAIN_PATTERN) & F.length(_c(c)).between(3, 255)


def digest(content: Column | str, algo: str = "sha256") -> Column:
    """SCA4: lower-case hex digest, ``md5`` or ``sha256``."""
    if algo not in ("md5", "sha256"):
        raise ValueError(f"unknown digest {algo}")
    return F.md5(_c(content)) if algo == "md5" else F.sha2(_c(content), 256)


def is_hex(c: Column | str) -> Column:
    """SCA5: the digest's form."""
    return _c(c).rlike(HEX_PATTERN)


def same_digest(a: Column | str, b: Column | str) -> Column:
    """SCA5: equal whatever the case."""
    return F.lower(_c(a)) == F.lower(_c(b))


def csv_field(c: Column | str) -> Column:
    """SCA6: quoted if it has a comma, quote or line feed (a bare carriage return is not quoted); null is empty."""
    c = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def plain_time(c: Column | str) -> Column:
    """SCA7: ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def iso_time(c: Column | str) -> Column:
    """SCA7: ISO local time, always with seconds, a fraction only where there is one, without trailing zeros."""
    c = _c(c)
    fraction = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def metadata_text(c: Column | str) -> Column:
    """SCA8: JSON text, empty for null and for an empty object."""
    c = _c(c)
    return F.when(c.isNull() | c.rlike(r"^\s*\{\s*\}\s*$"), F.lit("")).otherwise(c)


def cutoff(as_of: Column, minutes: int) -> Column:
    """SCA9: ``minutes`` before ``as_of``."""
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def remaining_minutes(started: Column, status: Column, as_of: Column, minutes: int) -> Column:
    """SCA10: whole minutes to the deadline; 0 when it has passed or the batch has ended."""
    left = F.floor((_micros(started) + minutes * 60_000_000 - _micros(as_of)) / 60_000_000)
    return F.when(status != "IN_PROGRESS", F.lit(0)).otherwise(F.greatest(F.lit(0), left)).cast("long")


def month_key(c: Column | str) -> Column:
    """SCA11: the month partition value ``yyyy_MM``."""
    return F.date_format(_c(c), "yyyy_MM")


def partition_name(c: Column | str) -> Column:
    """SCA11: ``error_logs_yyyy_MM``."""
    return F.concat(F.lit("error_logs_"), month_key(c))


def month_start(c: Column | str) -> Column:
    """SCA11: first day of the month."""
    return F.trunc(_c(c), "MM")


def month_end(c: Column | str) -> Column:
    """SCA11: first day of the next month, exclusive end of the partition."""
    return F.add_months(month_start(c), 1)


def next_month(as_of: Column | str) -> Column:
    """SCA12: the month whose partition is made ahead of time."""
    return F.add_months(month_start(as_of), 1)


def retention_cutoff(as_of: Column | str, months: int) -> Column:
    """SCA12: the last month that retention drops."""
    if months <= 0:
        raise ValueError("retention months must be positive")
    return F.add_months(month_start(as_of), -months)


def or_default(c: Column | str, text: str = "") -> Column:
    """SCA13."""
    return F.coalesce(_c(c), F.lit(text))


def client_address(forwarded: Column | str, peer: Column | str) -> Column:
    """SCA14: first entry of the forwarded-for list, else the peer's address."""
    forwarded = _c(forwarded)
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(forwarded.isNull() | (forwarded == ""), _c(peer)).otherwise(first)


def storage_path(account: Column | str, domain: Column | str, started: Column | str) -> Column:
    """PRJ7: ``account/domain/yyyy-MM-dd/HH-mm/``."""
    started = _c(started)
    return F.concat_ws("/", _c(account).cast("string"), _c(domain), F.date_format(started, "yyyy-MM-dd"), F.date_format(started, "HH-mm"), F.lit(""))


def object_key(path: Column | str, name: Column | str) -> Column:
    """PRJ8."""
    return F.concat(_c(path), _c(name))
