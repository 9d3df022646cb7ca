"""The fixed trip schema, the quality vocabulary and the rule limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
WIDE_MONEY = T.DecimalType(38, 2)

KIND_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "money": MONEY,
    "string": T.StringType(),
    "timestamp": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class TripField:
    name: str
    kind: str
    alias: str  # lower-cased source column
    required: bool = False


# Field name, kind and the source column that carries it (matched ignoring case).
TRIP_FIELDS: tuple[TripField, ...] = (
    TripField("vendor_id", "int", "vendorid"),
    TripField("pickup_datetime", "timestamp", "tpep_pickup_datetime", required=True),
    TripField("dropoff_datetime", "timestamp", "tpep_dropoff_datetime", required=True),
    TripField("passenger_count", "int", "passenger_count"),
    TripField("trip_distance", "double", "trip_distance"),
    TripField("pickup_location_id", "int", "pulocationid"),
    TripField("dropoff_location_id", "int", "dolocationid"),
    TripField("rate_code_id", "int", "ratecodeid"),
    TripField("store_and_fwd_flag", "string", "store_and_fwd_flag"),
    TripField("payment_type", "int", "payment_type"),
    TripField("fare_amount", "money", "fare_amount"),
    TripField("extra", "money", "extra"),
    TripField("mta_tax", "money", "mta_tax"),
    TripField("tip_amount", "money", "tip_amount"),
    TripField("tolls_amount", "money", "tolls_amount"),
    TripField("improvement_surcharge", "money", "improvement_surcharge"),
    TripField("total_amount", "money", "total_amount"),
    TripField("congestion_surcharge", "money", "congestion_surcharge"),
    TripField("airport_fee", "money", "airport_fee"),
    TripField("cbd_congestion_fee", "money", "cbd_congestion_fee"),
)
FIELD_NAMES: tuple[str, ...] = tuple(f.name for f in TRIP_FIELDS)
FIELDS_BY_NAME: dict[str, TripField] = {f.name: f for f in TRIP_FIELDS}

# What a frame of source rows carries besides the source's own columns: which monthly source a row is from.
SOURCE_KEYS: tuple[str, ...] = ("taxi_type", "data_period", "source_file", "run_id")

DERIVED: tuple[str, ...] = (
    "pickup_date",
    "pickup_hour",
    "pickup_day_of_week",
    "trip_duration_minutes",
    "average_speed_mph",
    "fare_per_mile",
    "is_distance_valid",
    "is_duration_valid",
    "is_amount_valid",
    "quality_flags",
)
LINEAGE: tuple[str, ...] = ("source_file", "run_id", "ingested_at", "data_period")
CURATED: tuple[str, ...] = ("taxi_type", *FIELD_NAMES, *DERIVED, *LINEAGE)
QUARANTINED: tuple[str, ...] = (
    "taxi_type",
    *FIELD_NAMES,
    "quarantine_reasons",
    "_cast_failures",
    *LINEAGE,
)

# A reason removes a row, a flag keeps it. The order is the order inside the arrays.
REASONS: tuple[str, ...] = (
    "missing_required_timestamp",
    "dropoff_before_pickup",
    "pickup_outside_source_period",
    "duplicate_record",
)
FLAGS: tuple[str, ...] = (
    "invalid_distance",
    "invalid_duration",
    "invalid_amount",
    "implausible_speed",
    "passenger_count_missing_or_zero",
    "pickup_zone_unmapped",
    "dropoff_zone_unmapped",
)

# Zone ids of the lookup that name no place, and the largest id a lookup may hold.
NON_GEOGRAPHIC_ZONES: tuple[int, ...] = (264, 265)
MAX_ZONE_ID = 10_000

# Code labels.
PAYMENT_LABELS: dict[int, str] = {
    0: "Flex Fare",
    1: "Credit card",
    2: "Cash",
    3: "No charge",
    4: "Dispute",
    5: "Unknown",
    6: "Voided trip",
}
VENDOR_LABELS: dict[int, str] = {
    1: "Creative Mobile Technologies",
    2: "Curb Mobility",
    6: "Myle Technologies",
    7: "Helix",
}
WEEKDAY_SHORT: tuple[str, ...] = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WEEKDAY_LONG: tuple[str, ...] = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)
REASON_LABELS: dict[str, str] = {
    "missing_required_timestamp": "Missing or unreadable timestamp",
    "dropoff_before_pickup": "Drop-off before pickup",
    "pickup_outside_source_period": "Outside the file’s month",
    "duplicate_record": "Exact duplicate",
}
FLAG_LABELS: dict[str, str] = {
    "invalid_distance": "Implausible distance",
    "invalid_duration": "Implausible duration",
    "invalid_amount": "Implausible amount",
    "implausible_speed": "Implausible speed",
    "passenger_count_missing_or_zero": "No passenger count",
    "pickup_zone_unmapped": "Pickup zone unknown",
    "dropoff_zone_unmapped": "Drop-off zone unknown",
}


@dataclass(frozen=True)
class Rules:
    """Limits behind the validity columns; a run may use its own."""

    max_distance_miles: float = 200.0
    max_duration_minutes: float = 720.0
    max_total_usd: float = 1000.0
    max_speed_mph: float = 80.0

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if not value > 0:
                raise ValueError(f"{name} must be positive")
