"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import batches, layouts, records, reports, sources, texts

QUERIES: dict = {**reports.QUERIES, **texts.QUERIES, **batches.QUERIES, **layouts.QUERIES, **records.QUERIES, **sources.QUERIES}
ORACLE_SQL: dict = {**reports.ORACLE_SQL, **texts.ORACLE_SQL, **batches.ORACLE_SQL, **layouts.ORACLE_SQL, **records.ORACLE_SQL, **sources.ORACLE_SQL}
