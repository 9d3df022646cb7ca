"""Match source columns to the fixed trip fields, and fingerprint source schemas."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.schema import TRIP_FIELDS


class SourceError(ValueError):
    """A source file that must not be published."""


@dataclass(frozen=True)
class SchemaMapping:
    columns: dict[str, str]  # source column -> type
    by_field: dict[str, str]  # trip field -> source column
    unavailable: tuple[str, ...]
    unexpected: tuple[str, ...]
    version: str


def column_types(schema: T.StructType) -> dict[str, str]:
    return {field.name: field.dataType.simpleString() for field in schema.fields}


def fingerprint(taxi_type: str, columns: Mapping[str, str]) -> str:
    text = ";".join(f"{name}:{columns[name]}" for name in sorted(columns))
    return f"{taxi_type}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def map_schema(taxi_type: str, schema: T.StructType | Mapping[str, str]) -> SchemaMapping:
    """Driver-side mapping of one schema; raises on a missing required field or columns equal but for case."""
    columns = column_types(schema) if isinstance(schema, T.StructType) else dict(schema)
    folded: dict[str, list[str]] = {}
    for name in columns:
        folded.setdefault(name.lower(), []).append(name)
    clashes = [names for names in folded.values() if len(names) > 1]
    if clashes:
        raise SourceError(f"ambiguous source columns differing only by case: {clashes}")
    by_field = {f.name: folded[f.alias][0] for f in TRIP_FIELDS if f.alias in folded}
    missing = [f.name for f in TRIP_FIELDS if f.required and f.name not in by_field]
    if missing:
        raise SourceError(f"required field not found: {', '.join(missing)}")
    return SchemaMapping(
        columns=columns,
        by_field=by_field,
        unavailable=tuple(f.name for f in TRIP_FIELDS if f.name not in by_field),
        unexpected=tuple(sorted(set(columns) - set(by_field.values()))),
        version=fingerprint(taxi_type, columns),
    )


# ---- the same over a registry of schemas: one row per source file, `columns` is map<column, type> ------------


def trip_fields() -> Column:
    """The fixed field list as an array of structs, ready to explode."""
    return F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field"),
                F.lit(f.kind).alias("kind"),
                F.lit(f.required).alias("required"),
                F.lit(f.alias).alias("alias"),
            )
            for f in TRIP_FIELDS
        ]
    )


def matches(columns: Column, alias: Column) -> Column:
    """Source columns equal to `alias` ignoring case."""
    return F.filter(F.map_keys(columns), lambda name: F.lower(name) == alias)


def with_fingerprint(schemas: DataFrame, taxi_type: str = "taxi_type", columns: str = "columns") -> DataFrame:
    """Adds `schema_version`; names are compared with case, as the types are."""
    entries = F.sort_array(F.map_entries(F.col(columns)))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    digest = F.substring(F.sha2(text, 256), 1, 12)
    return schemas.withColumn("schema_version", F.concat_ws("-", F.col(taxi_type), digest))


def schema_mapping(schemas: DataFrame, *keys: str) -> DataFrame:
    """One row per source and trip field, plus one per source column that has no meaning here.

    `status` is mapped, unavailable, missing_required, ambiguous or unexpected. A pure projection: every
    source's columns travel in one map, so no shuffle is needed whatever the number of sources.
    """
    found = matches(F.col("columns"), F.col("f.alias"))
    fields = schemas.select(*keys, "columns", F.explode(trip_fields()).alias("f")).select(
        *keys,
        F.col("f.field").alias("field"),
        F.get(found, F.lit(0)).alias("source_column"),
        F.when(F.size(found) > 1, "ambiguous")
        .when(F.size(found) == 1, "mapped")
        .when(F.col("f.required"), "missing_required")
        .otherwise("unavailable")
        .alias("status"),
    )
    known = F.array(*[F.lit(f.alias) for f in TRIP_FIELDS])
    extra = schemas.select(*keys, F.explode(F.map_keys("columns")).alias("source_column"))
    unexpected = extra.filter(~F.array_contains(known, F.lower("source_column"))).select(
        *keys, F.lit(None).cast("string").alias("field"), "source_column", F.lit("unexpected").alias("status")
    )
    return fields.unionByName(unexpected)
