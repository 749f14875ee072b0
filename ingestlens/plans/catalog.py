"""Every registered query of the library and the SQL that must give the same rows."""

from __future__ import annotations

from ingestlens.plans import audits, listings, replay, storage, streams

QUERIES: dict = listings.QUERIES | audits.QUERIES | replay.QUERIES | streams.QUERIES | storage.QUERIES
ORACLE_SQL: dict = listings.ORACLE_SQL | audits.ORACLE_SQL | replay.ORACLE_SQL | streams.ORACLE_SQL | storage.ORACLE_SQL
