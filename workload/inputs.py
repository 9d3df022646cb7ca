"""Companion inputs derived from the trip view and the text tables: registry, jobs, text exports, claims, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import quality, questions
from farebox.plans.route import TripStore
from farebox.sources.mapping import with_fingerprint
from workload import trips
from workload.trips import TAXI_TYPE, table

# ---- source schemas: one row per month of the trip view -------------------------------------------------------

# (column, type, first month, last month)
SCHEMA_HISTORY: tuple[tuple[str, str, str, str], ...] = (
    ("VendorID", "int64", "0000-00", "1996-12"),
    ("VendorID", "int32", "1997-01", "9999-99"),
    ("tpep_pickup_datetime", "timestamp", "0000-00", "9999-99"),
    ("tpep_dropoff_datetime", "timestamp", "0000-00", "9999-99"),
    ("passenger_count", "int64", "0000-00", "9999-99"),
    ("trip_distance", "double", "0000-00", "9999-99"),
    ("PULocationID", "int32", "0000-00", "9999-99"),
    ("DOLocationID", "int32", "0000-00", "9999-99"),
    ("payment_type", "int64", "0000-00", "9999-99"),
    ("fare_amount", "double", "0000-00", "9999-99"),
    ("total_amount", "double", "0000-00", "9999-99"),
    ("airport_fee", "double", "0000-00", "1997-05"),
    ("Airport_fee", "double", "1997-06", "9999-99"),
    ("trip_type", "string", "1998-01", "1998-12"),
    ("cbd_congestion_fee", "double", "1999-01", "9999-99"),
)


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = trips.source_rows(spark, sf_dir).groupBy("data_period").agg(F.count(F.lit(1)).alias("num_rows"))
    history = F.array(
        *[
            F.struct(F.lit(c).alias("key"), F.lit(t).alias("value"), F.lit(a).alias("a"), F.lit(b).alias("b"))
            for c, t, a, b in SCHEMA_HISTORY
        ]
    )
    period = month_text(F.col("data_period"))
    present = F.filter(history, lambda h: period.between(h["a"], h["b"]))
    registry = months.select(
        F.lit(TAXI_TYPE).alias("taxi_type"),
        period.alias("period"),
        F.concat(F.lit("yellow-"), period).alias("source_key"),
        F.when(F.year("data_period") == 1995, "csv").otherwise("parquet").alias("file_format"),
        F.map_from_entries(F.transform(present, lambda h: F.struct(h["key"], h["value"]))).alias("columns"),
        "num_rows",
    )
    return with_fingerprint(registry)


def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas(spark, sf_dir)


# ---- jobs and registered files --------------------------------------------------------------------------------


def manifest(registry: DataFrame) -> DataFrame:
    month = F.substring("period", 6, 2).cast("int")
    pinned = F.when(month % 2 == 0, F.sha2("source_key", 256))
    return registry.select("source_key", "taxi_type", "period", pinned.alias("expected_sha256"))


def registered_files(registry: DataFrame) -> DataFrame:
    month = F.substring("period", 6, 2).cast("int")
    return registry.filter(month != 7).select(
        "source_key", (F.col("num_rows") * 100).alias("bytes"), F.sha2("source_key", 256).alias("sha256"),
        "schema_version",
    )


def jobs(registry: DataFrame) -> DataFrame:
    """One to three attempts per source; the last one succeeded unless the month is December."""
    month = F.substring("period", 6, 2).cast("int")
    attempts = F.sequence(F.lit(1), month % 3 + 1)
    rows = registry.select("source_key", "period", month.alias("m"), F.explode(attempts).alias("attempt"))
    last = F.col("attempt") == F.col("m") % 3 + 1
    status = F.when(last & (F.col("m") != 12), "succeeded").when(F.col("attempt") == 1, "failed").otherwise("cancelled")
    start = F.to_timestamp(F.concat("period", F.lit("-01 00:00:00"))).cast("timestamp_ntz")
    return rows.select(
        "source_key",
        F.concat("source_key", F.lit("#"), F.col("attempt").cast("string")).alias("job_id"),
        status.alias("status"),
        (start + F.make_dt_interval(days=F.col("attempt"))).alias("created_at"),
        F.when(status == "succeeded", F.concat(F.lit("run-"), F.regexp_replace("period", "-", ""))).alias("run_id"),
    )


def runs(annotated: DataFrame, registry: DataFrame) -> DataFrame:
    """Run records with a run time and the schema version of their source."""
    version = registry.select(
        F.to_date(F.concat("period", F.lit("-01"))).alias("data_period"), "taxi_type", "schema_version"
    )
    seconds = (30 + (F.year("data_period") * 100 + F.month("data_period")) % 11).cast("double")
    record = quality.run_record(quality.run_metrics(annotated))
    return record.join(version, ["taxi_type", "data_period"], "left").withColumn("duration_seconds", seconds)


# ---- trips as text --------------------------------------------------------------------------------------------

TEXT_PATTERN = "MM/dd/yyyy hh:mm:ss a"
TEXT_COLUMNS = (
    "VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance", "PULocationID",
    "DOLocationID", "payment_type", "total_amount",
)


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trip view as an all-text export with blanks and unreadable values in it."""
    rows = trips.source_rows(spark, sf_dir)
    pu, do = F.col("PULocationID"), F.col("DOLocationID")
    broken = {
        "VendorID": F.when(pu % 13 == 0, "n/a").when(do % 17 == 0, "   ").otherwise(F.col("VendorID").cast("string")),
        "tpep_pickup_datetime": F.when(do % 29 == 0, "not a time").otherwise(
            F.date_format("tpep_pickup_datetime", TEXT_PATTERN)
        ),
        "tpep_dropoff_datetime": F.date_format("tpep_dropoff_datetime", TEXT_PATTERN),
        "passenger_count": F.when(pu % 19 == 0, "").otherwise(F.col("passenger_count").cast("string")),
        "trip_distance": F.when(do % 37 == 0, "far").otherwise(F.format_string("%.1f", "trip_distance")),
        "PULocationID": pu.cast("string"),
        "DOLocationID": do.cast("string"),
        "payment_type": F.col("payment_type").cast("string"),
        "total_amount": F.when(pu % 31 == 0, "abc").otherwise(F.format_string("%.2f", "total_amount")),
    }
    return rows.select(
        *[c.alias(n) for n, c in broken.items()], "taxi_type", "data_period", "source_file", "run_id"
    )


# ---- claims ---------------------------------------------------------------------------------------------------

RUNS = 80  # months in the trip view; text row k belongs to run k % 80


def month_index(day: Column) -> Column:
    return ((F.year(day) - 1995) * 12 + F.month(day) - 1).cast("long")


def claim_values(store: TripStore) -> DataFrame:
    """(run, field, number): each month's daily trips and amounts, as the numbers a text of that run may use."""
    days = questions.daily(store).select(
        month_index(F.col("pickup_date")).alias("run"),
        F.col("trips").alias("trips"),
        F.col("total_amount_valid_sum").cast("double").alias("amount"),
    )
    cells = F.array(
        F.struct(F.lit("trips").alias("field"), F.col("trips").cast("double").alias("number")),
        F.struct(F.lit("amount").alias("field"), F.col("amount").alias("number")),
    )
    return days.select("run", F.inline(cells))


def report_texts(store: TripStore) -> DataFrame:
    """Sentences about each day, some of them wrong, with dates and ids that are no claims."""
    days = questions.daily(store).select(
        "pickup_date",
        month_index(F.col("pickup_date")).alias("run"),
        F.col("trips").alias("n"),
        F.round(F.col("total_amount_valid_sum").cast("double"), 2).alias("usd"),
    )
    wrong = F.dayofmonth("pickup_date") % 3 == 0
    n = F.col("n") + F.when(wrong, 777).otherwise(0)
    text = F.concat(
        F.lit("1. On "), F.col("pickup_date").cast("string"), F.lit(" zone 132 saw "), n.cast("string"),
        F.lit(" trips over 31 days worth $"), F.format_string("%.2f", "usd"), F.lit(" ("),
        F.format_string("%.1f", F.col("n").cast("double")), F.lit("%) by 18:00 in March 1997."),
    )
    return days.select(F.concat(F.lit("report-"), F.col("pickup_date").cast("string")).alias("id"), "run", text.alias("text"))


def claim_texts(spark: SparkSession, sf_dir: str, store: TripStore) -> DataFrame:
    """(id, run, text): whole texts of every conversation turn, every document and every day's sentence."""
    talks = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("id"), (F.col("conv_id") % RUNS).alias("run"), "text"
    )
    docs = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", F.lit("doc"), "doc_id").alias("id"), (F.col("doc_id") % RUNS).alias("run"), "text"
    )
    return talks.unionByName(docs).unionByName(report_texts(store))


# ---- scorecard ------------------------------------------------------------------------------------------------

TOOLS = ("overview", "series", "zones", "breakdown")
METRIC_ARGS = ("total_trips", "avg_total_amount", "avg_trip_distance")
# What a tool uses where a call leaves an argument out; `breakdown` has no default metric.
TOOL_DEFAULTS = {"overview": {"metric": "total_trips"}, "series": {"metric": "avg_total_amount"}, "zones": {"metric": "avg_trip_distance"}}


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored case per conversation: its turns are the calls, its last turn the answer, or what is asked back.

    Every fourth call leaves its metric to the tool's default.
    """
    talks = table(spark, sf_dir, "conversations")
    c = F.col("conv_id")

    def call(t: Column) -> Column:
        limit = F.create_map(F.lit("limit"), t.cast("string"))
        named = F.map_concat(limit, F.create_map(F.lit("metric"), _pick(METRIC_ARGS, c + t)))
        arguments = F.when((c + t) % 4 == 3, limit).otherwise(named)
        return F.struct(
            _pick(TOOLS, c + t).alias("tool"),
            F.when(t % 3 == 2, "error").otherwise("ok").alias("status"),
            arguments.alias("arguments"),
        )

    grouped = talks.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("turn")), call).alias("calls"),
        F.max_by("text", "turn").alias("answer"),
        F.count(F.lit(1)).alias("model_calls"),
    )
    none = F.array().cast("array<string>")
    size = F.length("answer")
    return grouped.select(
        "conv_id",
        (c % 3).alias("repeat"),
        F.when(c % 5 == 0, "injection").when(c % 5 == 1, "ambiguous").otherwise("data").alias("kind"),
        F.when(c % 7 == 0, "failed").when(c % 7 == 1, "clarification").otherwise("answered").alias("status"),
        "calls",
        F.when(c % 7 != 1, F.col("answer")).alias("answer"),
        F.when(c % 7 == 1, F.col("answer")).alias("clarification"),
        "model_calls",
        F.when(c % 3 != 0, F.array(_pick(TOOLS, c), _pick(TOOLS, c + 1))).otherwise(none).alias("expect_tools"),
        F.when(c % 11 == 0, F.array(_pick(TOOLS, c + 2))).otherwise(none).alias("expect_also"),
        F.when(c % 4 != 0, F.create_map(F.lit("metric"), _pick(METRIC_ARGS, c + 1))).alias("expect_args"),
        F.when(c % 6 != 0, F.array(F.lit("EN"), F.lit("a"))).otherwise(none).alias("expect_text"),
        F.when(c % 5 == 0, F.array(F.lit("(?i)de[rs]"), F.lit("tion"))).otherwise(none).alias("forbid"),
        (size % 6).cast("long").alias("figures"),
        F.least(size % 6, size % 4).cast("long").alias("figures_verified"),
        (size % 100 / 10.0).alias("seconds"),
    )
