"""Source schemas over time: which fields each month has, versions, and what changed between months.

The registry has one row per source file (taxi_type, period, source_key, file_format, schema_version,
columns map<column, type>); its size is the number of monthly files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.operators.questions import ROW_COLUMNS
from farebox.schema import FIELDS_BY_NAME
from farebox.sources.mapping import matches, trip_fields


def field_availability(schemas: DataFrame) -> DataFrame:
    """Per trip field: the source column of every month, and in how many months there is one."""
    per_file = schemas.select(
        "period", "source_key", "columns", F.explode(trip_fields()).alias("f")
    ).select(
        "period",
        "source_key",
        "f.field",
        "f.kind",
        "f.required",
        F.get(matches(F.col("columns"), F.col("f.alias")), F.lit(0)).alias("source_column"),
    )
    # Two files of one month: the later key speaks for the month.
    month = per_file.groupBy("field", "kind", "required", "period").agg(
        F.max_by("source_column", "source_key").alias("source_column"), F.count(F.lit(1)).alias("files")
    )
    pair = F.struct("period", "source_column")
    return month.groupBy("field", "kind", "required").agg(
        F.count("source_column").alias("available_in"),
        F.sum("files").alias("periods"),
        F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("source_columns"),
    )


def schema_versions(schemas: DataFrame) -> DataFrame:
    """Months and column count of each schema version."""
    first = F.struct("period", "source_key")
    months = F.sort_array(F.collect_list(F.struct("period", "source_key")))
    version = F.coalesce("schema_version", F.lit("unknown")).alias("schema_version")
    return schemas.groupBy(version).agg(
        F.min_by("file_format", first).alias("file_format"),
        F.min_by(F.size("columns"), first).alias("column_count"),
        F.transform(months, lambda m: m["period"]).alias("periods"),
    )


def _names(columns: str) -> Column:
    return F.map_keys(F.col(columns))


def _folded(columns: str) -> Column:
    return F.transform(_names(columns), F.lower)


def schema_drift(schemas: DataFrame) -> DataFrame:
    """Column changes between each file and the one before it.

    Both column maps meet in one row, so names are matched inside the row instead of by a join.
    """
    order = Window.partitionBy("taxi_type").orderBy("period", "source_key")
    pairs = schemas.withColumns(
        {"before": F.lag("columns").over(order), "from_period": F.lag("period").over(order)}
    ).filter(F.col("before").isNotNull())

    def only_in(here: str, there: str) -> Column:
        return F.sort_array(F.filter(_names(here), lambda n: ~F.array_contains(_folded(there), F.lower(n))))

    both = F.transform(
        F.sort_array(F.filter(_folded("columns"), lambda n: F.array_contains(_folded("before"), n))),
        lambda n: F.struct(
            F.get(matches(F.col("before"), n), F.lit(0)).alias("old"),
            F.get(matches(F.col("columns"), n), F.lit(0)).alias("new"),
        ),
    )
    renamed = F.transform(
        F.filter("both", lambda p: p["old"] != p["new"]),
        lambda p: F.struct(p["old"].alias("from"), p["new"].alias("to")),
    )
    typed = F.transform(
        F.col("both"),
        lambda p: F.struct(
            p["new"].alias("column"),
            F.element_at("before", p["old"]).alias("from"),
            F.element_at("columns", p["new"]).alias("to"),
        ),
    )
    changes = pairs.withColumn("both", both).select(
        "taxi_type",
        "from_period",
        F.col("period").alias("to_period"),
        only_in("columns", "before").alias("added"),
        only_in("before", "columns").alias("removed"),
        renamed.alias("renamed_case"),
        F.filter(typed, lambda t: t["from"] != t["to"]).alias("type_changed"),
    )
    found = ("added", "removed", "renamed_case", "type_changed")
    total = sum((F.size(c) for c in found), F.lit(0))
    return changes.withColumn("changed", total > 0).orderBy("taxi_type", "to_period")


# Units and codes of the explorer's columns.
UNITS: dict[str, str] = {
    "trip_distance": "miles",
    "trip_duration_minutes": "minutes",
    "average_speed_mph": "mph",
    "fare_amount": "USD",
    "tip_amount": "USD",
    "tolls_amount": "USD",
    "total_amount": "USD",
    "congestion_surcharge": "USD",
    "airport_fee": "USD",
    "cbd_congestion_fee": "USD",
}
CODES: dict[str, str] = {
    "payment_type": "0 Flex Fare, 1 Credit card, 2 Cash, 3 No charge, 4 Dispute, 5 Unknown, 6 Voided trip",
    "vendor_id": "1 Creative Mobile Technologies, 2 Curb Mobility, 6 Myle Technologies, 7 Helix",
    "rate_code_id": "1 Standard, 2 JFK, 3 Newark, 4 Nassau/Westchester, 5 Negotiated, 6 Group ride, 99 Unknown",
}
COMPUTED: dict[str, str] = {
    "trip_duration_minutes": "double",
    "average_speed_mph": "double",
    "quality_flags": "array",
    "source_file": "string",
    "run_id": "string",
}


def field_catalogue(availability: DataFrame) -> DataFrame:
    """Each explorer column: origin, type, unit, codes, and for source fields where they come from."""
    cells = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(name).alias("field"),
            F.lit("source" if name in FIELDS_BY_NAME else "derived").alias("origin"),
            F.lit(FIELDS_BY_NAME[name].kind if name in FIELDS_BY_NAME else COMPUTED[name]).alias("type"),
            F.lit(UNITS.get(name)).cast("string").alias("unit"),
            F.lit(CODES.get(name)).cast("string").alias("codes"),
        )
        for i, name in enumerate(ROW_COLUMNS)
    ]
    static = availability.sparkSession.range(1).select(F.inline(F.array(*cells)))
    columns = F.filter(F.array_distinct(F.map_values("source_columns")), lambda c: c.isNotNull())
    known = availability.select(
        "field", F.sort_array(columns).alias("source_columns"), "available_in", "periods"
    )
    return static.join(known, "field", "left").orderBy("position")
