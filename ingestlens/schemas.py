"""The five tables' schemas, status values and default limits.

Keys carry their table's name (``account_id`` and so on). Operators compare keys
only for equality and order, so string and number keys both work.
"""

from __future__ import annotations

from pyspark.sql import types as T

IN_PROGRESS, COMPLETED, FAILED, CANCELLED, NOT_COMPLETED = "IN_PROGRESS", "COMPLETED", "FAILED", "CANCELLED", "NOT_COMPLETED"
STATUSES = (IN_PROGRESS, COMPLETED, FAILED, CANCELLED, NOT_COMPLETED)
TERMINAL = STATUSES[1:]

TIMEOUT_MINUTES, ACCOUNT_LIMIT, FILES_PER_BATCH, MAX_FILE_BYTES = 60, 5, 1000, 134_217_728
METADATA_ENTRIES, METADATA_KEY_LENGTH, METADATA_BYTES = 20, 100, 10_240


def _table(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "b": T.BooleanType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampNTZType()}
    fields = (f.split(":") for f in text.split())
    return T.StructType([T.StructField(n, kinds[k[0]], k.endswith("?")) for n, k in fields])


ACCOUNTS = _table("account_id:s email:s name:s is_active:b created_at:t updated_at:t")
SITES = _table("site_id:s account_id:s domain:s display_name:s is_active:b created_at:t updated_at:t")
BATCHES = _table(
    "batch_id:s account_id:s site_id:s status:s s3_path:s uploaded_files_count:i total_size:l has_errors:b started_at:t completed_at:t? created_at:t"
)
FILES = _table("file_id:s batch_id:s original_file_name:s s3_key:s file_size:l content_type:s checksum:s uploaded_at:t")
ERRORS = _table(
    "error_id:s site_id:s batch_id:s? type:s title:s message:s stack_trace:s? client_version:s? metadata:s? occurred_at:t created_at:t ym:s"
)
#: START, UPLOAD, COMPLETE, FAIL, CANCEL and ERROR rows; event time is TIMESTAMP because watermarks need it.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("t", T.TimestampType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_size", T.LongType()),
    ]
)
TABLES = {"accounts": ACCOUNTS, "sites": SITES, "batches": BATCHES, "uploaded_files": FILES, "error_logs": ERRORS}
