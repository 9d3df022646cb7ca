"""A trip view over the driver's tables, shaped like monthly source files.

The driver's tables hold no trips. This view turns every `lineitem` row joined to its order into one source
row; every registered query starts from it (or from the text tables), so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import clean
from farebox.session import prepare
from farebox.sources.mapping import SchemaMapping, map_schema

TAXI_TYPE = "yellow"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after(day: Column, minutes: Column) -> Column:
    return day + F.make_dt_interval(mins=minutes.cast("int"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-shaped rows: physical names and types of a monthly file, plus the source keys."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ln, day = F.col("l_linenumber").cast("long"), F.col("o_orderdate")
    start = (ok * 7 + ln * 131 + pk * 17) % 1440
    length = F.when(ok % 97 == 0, F.lit(900).cast("long")).otherwise((pk * 3 + ln * 5) % 90 - 2)
    cents = F.floor(F.col("l_extendedprice") / 10)
    sign = F.when(ok % 61 == 0, -1).when(ok % 13 == 0, 3).otherwise(1)
    fare = sign * cents / F.lit(100.0)
    passengers = F.when(~((F.col("l_returnflag") == "R") & (ln == 1)), ln % 5)
    month = F.trunc(day, "month")
    copies = F.sequence(F.lit(1), F.when(ok % 173 == 0, 2).otherwise(1))
    columns = {
        "VendorID": F.when(
            sk % 11 != 0,
            F.when(sk % 4 == 0, 1).when(sk % 4 == 1, 2).when(sk % 4 == 2, 6).otherwise(7),
        ).cast("int"),
        "tpep_pickup_datetime": F.when(ok % 211 != 0, minutes_after(day, start)),
        "tpep_dropoff_datetime": minutes_after(day, start + length),
        "passenger_count": passengers,
        "trip_distance": F.when(pk % 50 == 0, 0.0)
        .when(pk % 101 == 0, 300.0)
        .when(pk % 7 == 0, F.col("l_quantity") * 2)
        .otherwise(F.col("l_quantity") / 2),
        "RatecodeID": F.lit(None).cast("long"),
        "store_and_fwd_flag": F.when(F.col("l_linestatus") == "F", "Y").otherwise("N"),
        "PULocationID": (pk % 265 + 1).cast("int"),
        "DOLocationID": ((sk * 7 + ln * 31) % 265 + 1).cast("int"),
        "payment_type": ln % 7,
        "fare_amount": fare,
        "extra": F.lit(1.0),
        "mta_tax": F.lit(0.5),
        "tip_amount": F.lit(0.0),
        "tolls_amount": F.lit(0.0),
        "improvement_surcharge": F.lit(1.0),
        "total_amount": fare + F.when(ok % 307 == 0, 5000).otherwise(2),
        "congestion_surcharge": F.when(passengers.isNotNull(), 2.5),
        "Airport_fee": F.when(passengers.isNotNull(), 0.0),
        "taxi_type": F.lit(TAXI_TYPE),
        "data_period": F.when(ok % 191 == 0, F.add_months(month, 1)).otherwise(month),
    }
    # At scale both sides are large; asking for that plan outright keeps small runs representative.
    shaped = items.join(orders.hint("merge"), ok == F.col("o_orderkey")).select(
        *[value.alias(name) for name, value in columns.items()], F.explode(copies).alias("copy")
    )
    label = F.date_format("data_period", "yyyy-MM")
    return shaped.drop("copy").withColumns(
        {
            "source_file": F.concat(F.lit("yellow_tripdata_"), label, F.lit(".parquet")),
            "run_id": F.concat(F.lit("run-"), F.date_format("data_period", "yyyyMM")),
        }
    )


def source_mapping(rows: DataFrame) -> SchemaMapping:
    keys = ("taxi_type", "data_period", "source_file", "run_id")
    return map_schema(TAXI_TYPE, rows.drop(*keys).schema)


def zone_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone lookup as text, ids 1..265: borough and name from region and nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ids = nation.select(
        "n_name", "n_regionkey",
        F.explode(
            F.filter(F.sequence(F.lit(1), F.lit(265)), lambda i: i % 25 == F.col("n_nationkey"))
        ).alias("id"),
    )
    return ids.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("id").cast("string").alias("LocationID"),
        F.concat(F.lit(" "), "r_name", F.lit(" ")).alias("Borough"),
        F.concat("n_name", F.lit("-"), F.col("id").cast("string")).alias("Zone"),
        F.lit("Zone ").alias("service_zone"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from farebox.sources.zones import zone_dimension

    return zone_dimension(zone_text(spark, sf_dir))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_rows(spark, sf_dir)
    return clean.normalize(rows, source_mapping(rows))


def annotated(spark: SparkSession, sf_dir: str, in_order: bool = True) -> DataFrame:
    rows = source_rows(spark, sf_dir)
    return clean.clean(rows, source_mapping(rows), zones(spark, sf_dir), in_order=in_order)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.accepted(annotated(spark, sf_dir))
