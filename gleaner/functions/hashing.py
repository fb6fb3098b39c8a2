"""Identifiers from canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields in the order of their names, nulls kept."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def hashed_id(prefix: str, fields: dict[str, Column]) -> Column:
    """The prefix and 24 digits of the SHA-256 of the fields' canonical JSON."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(fields), 256), 1, 24))


def ingest_id(fields: dict[str, Column]) -> Column:
    return hashed_id("raw_", fields)


def event_id(fields: dict[str, Column]) -> Column:
    return hashed_id("evt_", fields)
