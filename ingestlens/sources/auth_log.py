"""The services' JSON log, one object a line, and the authentication failures in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestlens.functions import scalars as S

#: The encoder's fields, all as text, so that a number where a string was, or the reverse, is no broken line.
FIELDS = ("@timestamp", "level", "logger", "thread", "message", "application", "ip", "endpoint", "method", "status", "tokenType", "batchId", "siteId", "accountId")
#: Contexts may be nested below ``mdc`` instead of beside the other fields.
SCHEMA = ", ".join([*(f"`{f}` string" for f in FIELDS), "mdc struct<ip:string,endpoint:string,method:string,status:string,tokenType:string>", "_broken string"])
#: Fixed: how the message of a failure begins, and its parts.
FAILURE = r"^auth_failure: Authentication failed for (\S+) (\S+) from (.*)$"


def read_log(spark: SparkSession, path: str, streaming: bool = True, **options) -> DataFrame:
    """Lines of the log with :data:`FIELDS`, ``t`` and ``reason``: BROKEN_JSON, NO_TIME or null for a line that can be used.

    Fields that are missing are null, further ones are ignored: a service that
    logs more or less than another makes no line unreadable. ``_broken`` holds a
    line that is no JSON object, as it came.
    """
    reader = (spark.readStream if streaming else spark.read).schema(SCHEMA).option("columnNameOfCorruptRecord", "_broken").options(**options)
    lines = reader.json(path)
    t = F.try_to_timestamp("@timestamp")
    reason = F.when(F.col("_broken").isNotNull(), "BROKEN_JSON").when(t.isNull(), "NO_TIME")
    return lines.withColumns({"t": t, "reason": reason})


def _context(name: str, part: int) -> Column:
    """A context field: beside the others, below ``mdc``, or else the part of the message that repeats it."""
    said = F.regexp_extract("message", FAILURE, part)
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.nullif(F.col(f"mdc.{name}"), F.lit("")), F.nullif(said, F.lit("")))


def failures(log: DataFrame) -> DataFrame:
    """``t, address, endpoint, method, status, token_type`` of the failures among the usable lines.

    The encoder writes only the contexts it is told to; where it leaves these
    out, address, endpoint and method are taken from the message. An address may
    be a list of forwarding ones, of which the first is the client's.
    """
    failed = log.filter(F.col("reason").isNull() & F.col("message").startswith("auth_failure:"))
    return failed.select(
        "t",
        S.client_address(_context("ip", 3), F.lit(None)).alias("address"),
        _context("endpoint", 2).alias("endpoint"),
        _context("method", 1).alias("method"),
        F.coalesce("status", "mdc.status").alias("status"),
        F.coalesce("tokenType", "mdc.tokenType").alias("token_type"),
    )


def rejected_lines(log: DataFrame) -> DataFrame:
    """``reason, line`` of the lines that cannot be used; a line without a time is given by its message."""
    return log.filter(F.col("reason").isNotNull()).select("reason", F.coalesce("_broken", "message").alias("line"))
