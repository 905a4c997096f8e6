"""Typed metadata: JSON of any shape as VARIANT values, read by path and type, and envelopes merged by version.

An envelope is {"version": n, "type": t, "fields": {...}}. `merge` takes one envelope a key: the highest version decides the type, and
each field comes from the highest version that has it with a value. Records that are no JSON object, or name no version, are
version 0 without fields; of equal versions the greater text wins, so the result does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A VARIANT, null where the text is no JSON."""
    return F.try_parse_json(text)


def typed(value: Column, path: str, kind: str) -> Column:
    """What lies at a path, null where it is missing or of another kind."""
    return F.try_variant_get(value, path, kind)


def shapes(rows: DataFrame, text: str) -> DataFrame:
    """One row: the schema that all records of a column have together, and how many are no JSON."""
    value = parsed(F.col(text))
    return rows.agg(F.schema_of_variant_agg(value).alias("shape"), F.count_if(value.isNull()).alias("malformed"), F.count(F.lit(1)).alias("records"))


def merge(rows: DataFrame, key: str, text: str, fields: dict[str, str]) -> DataFrame:
    """(key, version, type, one column a field, records) by the rules above; fields: name and kind."""
    value = parsed(F.col(text))
    read = rows.select(
        F.col(key), F.coalesce(typed(value, "$.version", "int"), F.lit(0)).alias("version"), typed(value, "$.type", "string").alias("type"),
        *[typed(value, f"$.fields.{name}", kind).alias(name) for name, kind in fields.items()], F.col(text).alias("raw"),
    )
    rank = F.struct("version", "raw")
    # max_by leaves out rows whose rank is null: a field's rank is null where it has no value.
    best = [F.max_by(name, F.when(F.col(name).isNotNull(), rank)).alias(name) for name in fields]
    return read.groupBy(key).agg(F.max("version").alias("version"), F.max_by("type", rank).alias("type"), *best, F.count(F.lit(1)).alias("records"))
