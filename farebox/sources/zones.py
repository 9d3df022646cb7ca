"""The zone lookup: a dimension bounded by its own id range, so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.schema import MAX_ZONE_ID, NON_GEOGRAPHIC_ZONES
from farebox.sources.files import read_header
from farebox.sources.mapping import SourceError

ZONE_HEADER = ["LocationID", "Borough", "Zone", "service_zone"]  # fixed value: the lookup's header


def zone_dimension(text: DataFrame) -> DataFrame:
    """Typed zones from the lookup's text columns."""
    location = F.col("LocationID").try_cast("int")
    return text.select(
        location.alias("location_id"),
        F.trim("Borough").alias("borough"),
        F.trim("Zone").alias("zone"),
        F.trim("service_zone").alias("service_zone"),
        ~location.isin(*NON_GEOGRAPHIC_ZONES),
    ).toDF("location_id", "borough", "zone", "service_zone", "is_geographic")


def check_zones(zones: DataFrame) -> None:
    """Raise unless the ids are integers in range and unique and there is at least one row."""
    usable = F.col("location_id").between(1, MAX_ZONE_ID)
    row = zones.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(usable, F.lit(False))).alias("good"),
        F.count_distinct("location_id").alias("ids"),
    ).first()
    if row.n == 0:
        raise SourceError("zone lookup is empty")
    if row.good != row.n or row.ids != row.n:
        raise SourceError("zone lookup has an invalid or duplicate LocationID")


def load_zones(spark: SparkSession, path: str) -> DataFrame:
    header = read_header(spark, path)
    if header != ZONE_HEADER:
        raise SourceError(f"unexpected zone lookup header: {header}")
    text = (
        spark.read.schema(", ".join(f"`{c}` string" for c in ZONE_HEADER))
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    zones = zone_dimension(text)
    check_zones(zones)
    return zones


def geographic_ids(zones: DataFrame) -> DataFrame:
    return zones.filter("is_geographic").select("location_id").orderBy("location_id")


def bounded_zones(zones: DataFrame) -> DataFrame:
    """The zones as they are, or an error where an id is out of range or there twice; so at most MAX_ZONE_ID rows."""
    usable = F.col("location_id").between(1, MAX_ZONE_ID) & (F.count(F.lit(1)).over(Window.partitionBy("location_id")) == 1)
    wrong = F.raise_error(F.lit("zone lookup has an invalid or duplicate LocationID")).cast("boolean")
    return zones.withColumn("_usable", F.coalesce(usable, F.lit(False))).filter(F.when(F.col("_usable"), True).otherwise(wrong)).drop("_usable")
