"""Labels for codes, zones, weekdays, reasons and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.schema import (
    FLAG_LABELS,
    PAYMENT_LABELS,
    REASON_LABELS,
    VENDOR_LABELS,
    WEEKDAY_LONG,
    WEEKDAY_SHORT,
)
from farebox.sources.zones import bounded_zones


def lookup(key: Column, labels: Mapping) -> Column:
    """The label of a key from a small fixed table; NULL for a key it does not hold."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)


def code_label(key: Column, labels: Mapping[int, str], kind: str) -> Column:
    unknown = F.concat(F.lit(f"{kind} "), key.cast("string"), F.lit(" (undocumented)"))
    return F.when(key.isNull(), "Not recorded").otherwise(F.coalesce(lookup(key, labels), unknown))


def payment_label(key: Column) -> Column:
    return code_label(key.cast("int"), PAYMENT_LABELS, "Payment type")


def vendor_label(key: Column) -> Column:
    return code_label(key.cast("int"), VENDOR_LABELS, "Vendor")


def weekday_label(key: Column, names: Sequence[str] = WEEKDAY_SHORT) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), key.cast("int") - 1)


def weekday_name(key: Column) -> Column:
    return weekday_label(key, WEEKDAY_LONG)


def hour_label(key: Column) -> Column:
    return F.concat(F.lpad(key.cast("string"), 2, "0"), F.lit(":00"))


def reason_label(key: Column) -> Column:
    return F.coalesce(lookup(key, REASON_LABELS), key)


def flag_label(key: Column) -> Column:
    return F.coalesce(lookup(key, FLAG_LABELS), key)


def with_zone(df: DataFrame, zones: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Adds label, borough and mapped flag of a zone id; a zone that is no place is labelled unmapped."""
    places = bounded_zones(zones).filter("is_geographic")
    side = places.select(
        F.col("location_id").alias("_id"), F.col("zone").alias("_zone"), F.col("borough").alias("_borough")
    )
    unmapped = F.concat(F.lit("Unmapped ("), F.coalesce(F.col(key).cast("string"), F.lit("None")), F.lit(")"))
    return (
        df.join(F.broadcast(side), F.col(key) == F.col("_id"), "left")
        .withColumns(
            {
                f"{prefix}label": F.coalesce("_zone", unmapped),
                f"{prefix}borough": F.col("_borough"),
                f"{prefix}mapped": F.col("_id").isNotNull(),
            }
        )
        .drop("_id", "_zone", "_borough")
    )
