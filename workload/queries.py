"""Every registered query: (spark, sf_dir) -> DataFrame, each over the whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.functions import dates, labels, numbers
from farebox.operators import claims, clean, filters, insight, quality, questions, registry, rollups, scorecard
from farebox.operators.filters import TripFilter
from farebox.operators.metrics import METRICS
from farebox.plans import extract, publish, report
from farebox.plans.route import TripStore
from farebox.schema import FIELD_NAMES
from farebox.session import cut, scratch_path
from farebox.sources import files, mapping, zones
from farebox.sources.zones import ZONE_HEADER, load_zones
from workload import inputs, trips

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

Y1996 = TripFilter(start=dt.date(1996, 1, 1), end=dt.date(1996, 12, 31))
Y1997 = TripFilter(start=dt.date(1997, 1, 1), end=dt.date(1997, 12, 31))
TWO_MONTHS = TripFilter(start=dt.date(1997, 3, 1), end=dt.date(1997, 4, 30))
MIXED = TripFilter(
    start=dt.date(1996, 1, 1), end=dt.date(1998, 12, 31), payment_type=(1, 2, 3), hour=tuple(range(6, 22)),
    weekday=(1, 2, 3, 4, 5),
)
LONG_TRIPS = TripFilter(min_distance=2.0, max_distance=60.0)
MIN_GROUP = 100  # threshold of the "enough trips" tables, passed as a parameter


TIE = 1e-9  # far below the last digit shown; settles exact ties, which engines round either way


def _comparable(field: T.StructField) -> Column:
    """Plain types whose text is the same in any engine."""
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.DecimalType | T.FloatType | T.DoubleType):
        c = F.round(c.cast("double") + TIE, 6) + F.lit(0.0)
    elif isinstance(kind, T.IntegralType):
        c = c.cast("long")
    elif isinstance(kind, T.DateType):
        c = c.cast("string")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.ArrayType):
        c = F.array_join(c.cast("array<string>"), ";")
    elif isinstance(kind, T.MapType):
        entries = F.sort_array(F.map_entries(c))
        pairs = F.transform(
            entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))
        )
        c = F.array_join(pairs, ";")
    return c.alias(field.name)


def comparable(df: DataFrame) -> DataFrame:
    return df.select(*[_comparable(f) for f in df.schema.fields])


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        return fn

    return register


def store(spark: SparkSession, sf_dir: str) -> TripStore:
    fact = trips.fact(spark, sf_dir)
    return TripStore.over(fact, trips.zones(spark, sf_dir), quality.published_periods(fact))


def written_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips written once, as published ones are, for what reads them more than once.

    In order of time, which shortens later shuffles and files; only variants of a trip are ordered after the write.
    """
    whole = trips.annotated(spark, sf_dir, False).filter(F.size("_row_reasons") == 0)
    written = cut(whole.sortWithinPartitions(*publish.PARTITION, "pickup_datetime"), "fact")
    return clean.accepted(clean.ordered(written))


def written_store(spark: SparkSession, sf_dir: str) -> TripStore:
    """The store over written tables: trips, and the rollups that most questions go to."""
    fact = written_fact(spark, sf_dir)
    s = TripStore.over(fact, trips.zones(spark, sf_dir), quality.published_periods(fact))
    return replace(s, hourly=cut(s.hourly, "hourly"), dropoff_daily=cut(s.dropoff_daily, "dropoff-daily"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.run_metrics(trips.annotated(spark, sf_dir))


AVAILABLE = [n for n in FIELD_NAMES if n != "cbd_congestion_fee"]
TRIP_ID = ("pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "total_amount")


# ---- sources --------------------------------------------------------------------------------------------------


@query("scan_parquet")
def _(spark, sf):
    rows = files.read_parquet(spark, f"{sf}/lineitem.parquet")
    return rows.withColumn("source_file", F.element_at(F.split("source_path", "/"), -1)).drop("source_path")


def written_csv(spark, sf) -> str:
    path = scratch_path(spark, "csv")
    inputs.text_rows(spark, sf).select(*inputs.TEXT_COLUMNS).write.option("header", True).option("quoteAll", True).csv(path)
    return path


@query("scan_csv")
def _(spark, sf):
    """An all-text export written and read back, typed and counted per pickup month."""
    rows = files.read_csv(spark, written_csv(spark, sf), inputs.TEXT_COLUMNS).drop("source_path")
    typed = clean.normalize(rows, mapping.map_schema("yellow", rows.schema), inputs.TEXT_PATTERN, keep=())
    return typed.groupBy(F.trunc("pickup_datetime", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_amount").alias("amount"), F.count("vendor_id").alias("vendors"),
        F.sum("trip_distance").alias("miles"),
    )


@query("inspect_parquet")
def _(spark, sf):
    """Every table of the folder; a table may be one file or a folder of files."""
    found = files.inspect_parquet(spark, *[f"{sf}/{name}.parquet" for name in trips.TABLES])
    named = F.regexp_extract("file", r"/([^/]+\.parquet)(/|$)", 1)
    return found.groupBy(named.alias("file"), "column", "type").agg(F.sum("rows").alias("rows"))


@query("inspect_csv")
def _(spark, sf):
    return files.validate_csv(spark, written_csv(spark, sf))


def quoted_csv(spark, sf) -> str:
    """`documents` with a line break and quotes put into every text, one field of which then spans lines."""
    path = scratch_path(spark, "csv")
    broken = F.regexp_replace(F.coalesce("text", F.lit("")), "\\. ", '.\n"", ')
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", broken.alias("text"), "lang", "source")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


@query("scan_csv_quoted")
def _(spark, sf):
    """Texts of many lines written as CSV and read back split by split."""
    rows = files.read_csv(spark, quoted_csv(spark, sf), ["doc_id", "text", "lang", "source"], multi_line=True)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", "source"
    )


@query("inspect_csv_quoted")
def _(spark, sf):
    return files.validate_csv(spark, quoted_csv(spark, sf), multi_line=True)


@query("verify_checksums")
def _(spark, sf):
    """Every table file of the folder against pins taken from two of them, one wrong, and one file not there."""
    most = 1 << 30  # the limit below; a pin is never compared where the file is over it, so none is taken there

    found = spark.read.format("binaryFile").load(f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    digest = files.sha256_sums(spark, f"{sf}/orders.parquet", most).withColumnRenamed("sha256", "sha")
    names = found.join(digest, "file_name", "left")
    pin = F.when(F.col("file_name") == "orders.parquet", F.col("sha")).when(
        F.col("file_name") == "lineitem.parquet", F.lit("0" * 64)
    )
    listed = names.select(F.regexp_replace("file_name", "\\.parquet$", "").alias("source_key"), "file_name", pin.alias("expected_sha256"))
    gone = listed.limit(1).select(
        F.lit("gone").alias("source_key"), F.lit("gone.parquet").alias("file_name"), F.lit(None).cast("string").alias("expected_sha256")
    )
    return files.verify_manifest(spark, listed.unionByName(gone), sf, most).select("source_key", "file_name", "status")


@query("map_schema")
def _(spark, sf):
    return mapping.schema_mapping(inputs.schemas(spark, sf), "period")


@query("schema_fingerprint")
def _(spark, sf):
    return inputs.schemas(spark, sf).select("period", "schema_version")


def observed_zones(spark, sf) -> DataFrame:
    """Lookup rows of the zones that occur in the trips, so the dimension follows the data."""
    rows = trips.source_rows(spark, sf)
    seen = rows.select(F.explode(F.array("PULocationID", "DOLocationID")).alias("id")).distinct()
    return trips.zones(spark, sf).join(seen, F.col("location_id") == F.col("id"), "left_semi")


@query("load_zones")
def _(spark, sf):
    """The lookup written as CSV, as it is delivered, then read, typed and checked."""
    path = scratch_path(spark, "zones")
    seen = observed_zones(spark, sf).select(F.col("location_id").cast("string").alias("LocationID"))
    text = trips.zone_text(spark, sf).join(seen, "LocationID", "left_semi").select(*ZONE_HEADER)
    text.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)  # at most MAX_ZONE_ID rows
    return load_zones(spark, path)


@query("filter_listed")
def _(spark, sf):
    """Trips from zones with at least an even share of them; the zones come as a frame."""
    fact = written_fact(spark, sf)  # read three times
    per_zone = fact.groupBy("pickup_location_id").agg(F.count(F.lit(1)).alias("trips"))
    even = fact.agg(F.count(F.lit(1)) / F.lit(265.0)).scalar()
    busy = per_zone.where(F.col("trips") >= even).select("pickup_location_id")
    return filters.listed(fact, "pickup_zone", busy).groupBy("pickup_location_id").agg(F.count(F.lit(1)).alias("trips"))


# ---- sinks ----------------------------------------------------------------------------------------------------


@query("write_curated")
def _(spark, sf):
    path, fact = scratch_path(spark, "curated"), written_fact(spark, sf)
    publish.write_curated(fact, path, fact.count())
    back = spark.read.parquet(path)
    return back.groupBy("taxi_type", "data_period").agg(F.count(F.lit(1)).alias("rows"), F.sum("total_amount").alias("amount"))


@query("write_quarantine")
def _(spark, sf):
    path = scratch_path(spark, "quarantine")
    publish.write_quarantine(trips.annotated(spark, sf), path)
    return spark.read.parquet(path).select("data_period", *TRIP_ID, "quarantine_reasons", "source_file")


@query("publish_partition")
def _(spark, sf):
    """Staged months published twice: the second run replaces, it never appends."""
    stage, target, fact = scratch_path(spark, "stage"), scratch_path(spark, "target"), written_fact(spark, sf)
    publish.write_curated(fact, stage, fact.count())
    staged = spark.read.parquet(stage)
    publish.publish(staged, target)
    return publish.publish(staged, target)


@query("replace_dimension")
def _(spark, sf):
    path = scratch_path(spark, "zones")
    publish.replace_table(observed_zones(spark, sf).limit(0), path)
    publish.replace_table(observed_zones(spark, sf), path)
    return publish.current_table(spark, path)


def published_root(spark, sf) -> str:
    """The whole publication job over every month of the trip view."""
    root = scratch_path(spark, "published")
    publish.publish_normalized(spark, trips.normalized(spark, sf), trips.zones(spark, sf), root)
    return root


@query("publish_aggregates")
def _(spark, sf):
    """Rows of the rollups a publication made visible, month by month."""
    s = publish.open_store(spark, published_root(spark, sf), zones=trips.zones(spark, sf))
    return publish.rollup_rows({n: getattr(s, n) for n in rollups.ROLLUPS})


@query("backfill_aggregates")
def _(spark, sf):
    return publish.rebuild_rollups(spark, published_root(spark, sf))


@query("record_run")
def _(spark, sf):
    """Run and period rows added twice; the later publication wins."""
    root, annotated = scratch_path(spark, "runs"), cut(trips.annotated(spark, sf), "annotated")
    records = cut(quality.run_record(quality.run_metrics(annotated)), "records")
    periods = cut(quality.published_periods(clean.accepted(annotated)), "periods")
    for day in ("2020-01-01", "2020-01-02"):
        stamped = periods.withColumn("published_at", F.to_timestamp(F.lit(day)))
        publish.record_run(root, records, stamped)
    return publish.current_periods(spark, root)


EXTRACT_COLUMNS = (
    "pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "trip_distance", "total_amount",
    "quality_flags",
)


@query("extract_csv")
def _(spark, sf):
    return extract.extract(
        store(spark, sf), TripFilter(), EXTRACT_COLUMNS, sort="total_amount", quality="flagged"
    )


@query("csv_cell")
def _(spark, sf):
    start = F.substring(F.lit("=+-@ab"), (F.col("pickup_location_id") % 6 + 1).cast("int"), F.lit(1).cast("int"))
    fact = trips.fact(spark, sf)
    rows = fact.select(
        "pickup_datetime", "passenger_count", "total_amount", "is_amount_valid", "quality_flags",
        F.concat(start, "source_file").alias("note"), "pickup_date", "vendor_id",
    )
    return extract.csv_safe(rows)


# ---- cleaning -------------------------------------------------------------------------------------------------


@query("normalize")
def _(spark, sf):
    return trips.normalized(spark, sf).drop("taxi_type", "source_file", "run_id")


@query("blank_to_null")
def _(spark, sf):
    rows = inputs.text_rows(spark, sf)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("found"), clean.blank_to_null(F.col(c)).alias("read"))
            for c in ("VendorID", "passenger_count", "payment_type")
        ]
    )
    return rows.select(F.inline(pairs)).groupBy("column", "found", "read").agg(F.count(F.lit(1)).alias("rows"))


@query("parse_timestamp")
def _(spark, sf):
    text = F.col("tpep_pickup_datetime")
    parsed = clean.parse_timestamp(text, inputs.TEXT_PATTERN)
    return inputs.text_rows(spark, sf).select(text.alias("text"), parsed.alias("parsed"), "PULocationID", "DOLocationID")


@query("utc_to_wallclock")
def _(spark, sf):
    instant = F.col("tpep_pickup_datetime").cast("timestamp")
    return trips.source_rows(spark, sf).select(
        F.col("tpep_pickup_datetime").alias("utc"), clean.utc_to_wallclock(instant).alias("wallclock"), "PULocationID"
    )


def text_normalized(spark, sf) -> DataFrame:
    rows = inputs.text_rows(spark, sf)
    return clean.normalize(rows, trips.source_mapping(rows), inputs.TEXT_PATTERN)


@query("cast_failures")
def _(spark, sf):
    return text_normalized(spark, sf).groupBy("data_period", F.col("_cast_failures").alias("failures")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("duplicate_rank")
def _(spark, sf):
    return clean.mark_duplicates(trips.normalized(spark, sf)).select("data_period", *TRIP_ID, F.col("_dup_rank").alias("rank"))


@query("quarantine_reasons")
def _(spark, sf):
    rows = clean.annotated_rows(trips.annotated(spark, sf))
    return rows.select("data_period", *TRIP_ID, "quarantine_reasons")


@query("trip_duration")
def _(spark, sf):
    return trips.fact(spark, sf).select(*TRIP_ID, "trip_duration_minutes")


@query("validity_flags")
def _(spark, sf):
    return trips.fact(spark, sf).select(*TRIP_ID, "is_distance_valid", "is_duration_valid", "is_amount_valid")


@query("calendar_fields")
def _(spark, sf):
    return trips.fact(spark, sf).select(*TRIP_ID, "pickup_date", "pickup_hour", "pickup_day_of_week")


@query("speed")
def _(spark, sf):
    return trips.fact(spark, sf).select(*TRIP_ID, "average_speed_mph")


@query("fare_per_mile")
def _(spark, sf):
    return trips.fact(spark, sf).select(*TRIP_ID, "fare_per_mile")


@query("quality_flags")
def _(spark, sf):
    return trips.fact(spark, sf).select(*TRIP_ID, "quality_flags")


@query("lineage")
def _(spark, sf):
    rows = clean.with_ingest_time(trips.fact(spark, sf))
    return rows.groupBy("taxi_type", "source_file", "run_id", "data_period").agg(
        F.count(F.lit(1)).alias("rows"), F.count("ingested_at").alias("stamped")
    )


@query("split_accepted")
def _(spark, sf):
    annotated = trips.annotated(spark, sf)
    sides = [
        df.groupBy("data_period").agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit(side))
        for side, df in (("accepted", clean.accepted(annotated)), ("quarantined", clean.quarantined(annotated)))
    ]
    return sides[0].unionByName(sides[1])


# ---- quality --------------------------------------------------------------------------------------------------

PERIOD = ("data_period",)


@query("run_metrics")
def _(spark, sf):
    keep = [*quality.RUN_KEYS, *quality.COUNTS, "accepted_amount", "min_pickup_date", "max_pickup_date"]
    return metrics(spark, sf).select(*keep)


@query("reason_counts")
def _(spark, sf):
    return quality.reason_counts(metrics(spark, sf), PERIOD)


@query("flag_counts")
def _(spark, sf):
    return quality.flag_counts(metrics(spark, sf), PERIOD)


@query("missingness")
def _(spark, sf):
    return quality.missingness(metrics(spark, sf), AVAILABLE, PERIOD)


@query("missing_by_field")
def _(spark, sf):
    runs = metrics(spark, sf)
    return quality.missing_by_field(quality.missingness(runs, AVAILABLE), runs)


@query("cast_failure_counts")
def _(spark, sf):
    rows = clean.collapse_copies(text_normalized(spark, sf))
    annotated = clean.annotate(rows, trips.zones(spark, sf))
    fields = [n for n in FIELD_NAMES if n in mapping.map_schema("yellow", dict.fromkeys(inputs.TEXT_COLUMNS, "string")).by_field]
    return quality.cast_failure_counts(quality.run_metrics(annotated), fields, PERIOD)


@query("verify_staged")
def _(spark, sf):
    annotated = trips.annotated(spark, sf)
    return quality.verify_staged(clean.accepted(annotated), quality.run_metrics(annotated))


@query("verify_published")
def _(spark, sf):
    """A target that lost one day against what was staged: the check must name the months that differ."""
    staged = trips.fact(spark, sf)
    target = staged.filter(F.col("pickup_date") != F.lit(dt.date(1996, 5, 5)))
    return quality.verify_published(target, staged)


@query("verify_aggregates")
def _(spark, sf):
    s = store(spark, sf)
    return quality.verify_rollups(s.fact, s.hourly, s.dropoff_daily, s.buckets)


@query("coverage")
def _(spark, sf):
    return quality.coverage(store(spark, sf).periods)


@query("dataset_version")
def _(spark, sf):
    return quality.dataset_version(store(spark, sf).periods, F.lit(Y1996.start), F.lit(Y1996.end))


@query("source_status")
def _(spark, sf):
    known = inputs.schemas(spark, sf)
    return quality.source_status(
        inputs.manifest(known), inputs.registered_files(known), store(spark, sf).periods, inputs.jobs(known)
    )


@query("run_history")
def _(spark, sf):
    return quality.run_history(
        inputs.jobs(inputs.schemas(spark, sf)), metrics(spark, sf), status="succeeded", limit=50
    ).select("job_id", "source_key", "status", "created_at", "run_id", "input_rows", "accepted_rows", "quarantined_rows")


# ---- rollups --------------------------------------------------------------------------------------------------

for _name, _build in (
    ("agg_hourly", rollups.agg_hourly),
    ("agg_dropoff_daily", rollups.agg_dropoff_daily),
    ("agg_buckets", rollups.agg_buckets),
    ("agg_flags_daily", rollups.agg_flags_daily),
):
    query(_name)(lambda spark, sf, build=_build: build(trips.fact(spark, sf)).drop("data_period"))


# ---- filters --------------------------------------------------------------------------------------------------


def per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("pickup_date").agg(F.count(F.lit(1)).alias("trips"), F.sum("total_amount").alias("amount"))


@query("filter_published")
def _(spark, sf):
    """Only months whose run published at least as many rows as the average month."""
    fact = written_fact(spark, sf)
    periods = cut(quality.published_periods(fact), "periods")
    usual = periods.agg(F.avg("row_count")).scalar()
    return per_day(filters.published_in(fact.filter(F.col("taxi_type") == "yellow"), periods.filter(F.col("row_count") >= usual)))


for _name, _filter in (
    ("filter_date", Y1996),
    (
        "filter_lists",
        TripFilter(
            pickup_zone=tuple(range(1, 51)), dropoff_zone=tuple(range(100, 150)), payment_type=(0, 1, 2, 3, 4),
            vendor_id=(1, 2, 6), hour=tuple(range(0, 24, 2)), weekday=(1, 2, 3, 6, 7),
        ),
    ),
    ("filter_distance", LONG_TRIPS),
):
    query(_name)(lambda spark, sf, f=_filter: per_day(filters.apply(trips.fact(spark, sf), f)))


@query("filter_quality")
def _(spark, sf):
    fact = trips.fact(spark, sf)
    sides = [
        per_day(filters.with_quality(fact, scope)).withColumn("scope", F.lit(scope)) for scope in ("all", "clean", "flagged")
    ]
    return report.stack_all(sides)


@query("filter_flag")
def _(spark, sf):
    return per_day(filters.with_quality(trips.fact(spark, sf), flag="implausible_speed"))


QUESTIONS = [
    ("trips by hour", TripFilter(), ["hour"], "total_trips"),
    ("amount by payment and vendor", MIXED, ["payment_type", "vendor_id"], "total_recorded_amount"),
    ("duration by weekday and hour", Y1996, ["weekday", "hour"], "avg_trip_duration_minutes"),
    ("distance by pickup zone", TripFilter(vendor_id=(1, 2)), ["pickup_zone"], "avg_trip_distance"),
    ("amount by drop-off zone", TripFilter(payment_type=(1, 4)), ["dropoff_zone"], "avg_total_amount"),
    ("daily trips by drop-off zone filter", TripFilter(dropoff_zone=(1, 2, 3)), ["time:day"], "total_trips"),
    ("monthly trips per day", TripFilter(), ["time:month"], "avg_daily_trips"),
    ("hourly trips", TWO_MONTHS, ["time:hour"], "total_trips"),
]


@query("rollup_equals_fact")
def _(spark, sf):
    return questions.rollup_equals_fact(written_store(spark, sf), QUESTIONS)


def store_with_levels(spark: SparkSession, sf_dir: str) -> TripStore:
    """The store with its levels written and measured, as a published one has them."""
    s = written_store(spark, sf_dir)
    rows = cut(rollups.level_rows({"hourly": s.hourly, "dropoff_daily": s.dropoff_daily}), "levels")
    sizes = {r.level: r["count"] for r in rows.groupBy("level").count().collect()}
    return replace(s, levels={n: rows.where(F.col("level") == n) for n in sizes}, level_sizes=sizes)


LEVEL_QUESTIONS = [
    *QUESTIONS,
    ("trips by weekday and hour", TripFilter(), ["weekday", "hour"], "total_trips"),
    ("trips per day by hour", TripFilter(weekday=(1, 2)), ["hour"], "avg_daily_trips"),
    ("trips per day by pickup zone", TripFilter(), ["pickup_zone"], "avg_daily_trips"),
    ("trips per day by drop-off zone", TripFilter(), ["dropoff_zone"], "avg_daily_trips"),
    ("duration by vendor", TripFilter(payment_type=(1, 2)), ["vendor_id"], "avg_trip_duration_minutes"),
    ("trips per day", TripFilter(), [], "avg_daily_trips"),
    ("amount by day", Y1996, ["time:day"], "total_recorded_amount"),
    ("distance by zone and day", TWO_MONTHS, ["pickup_zone", "time:day"], "avg_trip_distance"),
]


@query("rollup_equals_fact_levels")
def _(spark, sf):
    return questions.rollup_equals_fact(store_with_levels(spark, sf), LEVEL_QUESTIONS)


@query("agg_levels")
def _(spark, sf):
    """Every level's rows, trips and day counts."""
    s = written_store(spark, sf)
    rows = rollups.level_rows({"hourly": s.hourly, "dropoff_daily": s.dropoff_daily})
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("trips").alias("trips"), F.sum("total_amount_valid_sum").alias("amount"),
        F.coalesce(F.sum(F.bitmap_count("days")), F.lit(0)).alias("days"),
    )


for _name, _dimensions in (("zone", ["pickup_zone"]), ("dropoff", ["dropoff_zone"]), ("clock", ["weekday", "hour"])):
    query(f"avg_daily_trips__{_name}_level")(
        lambda spark, sf, dimensions=_dimensions: questions.answer_rows(
            store_with_levels(spark, sf), TripFilter(), dimensions, "avg_daily_trips", False
        )
    )


# ---- metrics and questions ------------------------------------------------------------------------------------

for _key in METRICS:
    for _form, _fact in (("fact", True), ("rollup", False)):
        query(f"{_key}__{_form}")(
            lambda spark, sf, key=_key, fact=_fact: questions.metric_value(store(spark, sf), key, prefer_fact=fact)
        )

query("overview")(lambda spark, sf: questions.overview(store(spark, sf)))
query("overview__fact")(lambda spark, sf: questions.overview(store(spark, sf), LONG_TRIPS, prefer_fact=True))
query("overview__rollup")(lambda spark, sf: questions.overview(store(spark, sf), MIXED))


@query("previous_period")
def _(spark, sf):
    s = store(spark, sf)
    start = s.periods.agg(F.min("min_pickup_date")).scalar()
    return questions.compare_previous(s, Y1997, start)


query("series_day")(lambda spark, sf: questions.time_series(store(spark, sf), metric="avg_total_amount"))
query("series_month")(lambda spark, sf: questions.time_series(store(spark, sf), metric="avg_trip_distance", grain="month"))
query("series_hour")(lambda spark, sf: questions.time_series(store(spark, sf), grain="hour"))
query("by_hour")(lambda spark, sf: questions.breakdown(store(spark, sf), "hour", metric="avg_total_amount"))
query("by_weekday")(lambda spark, sf: questions.breakdown(store(spark, sf), "weekday", metric="avg_trip_duration_minutes"))
query("by_payment")(lambda spark, sf: questions.breakdown(store(spark, sf), "payment_type", metric="total_recorded_amount"))
query("by_vendor")(lambda spark, sf: questions.breakdown(store(spark, sf), "vendor_id"))
query("top_pickup_zones")(lambda spark, sf: questions.top_zones(store(spark, sf), "pickup", limit=20))
query("top_dropoff_zones")(lambda spark, sf: questions.top_zones(store(spark, sf), "dropoff", limit=20))
query("zone_totals")(lambda spark, sf: questions.zone_totals(store(spark, sf)))
query("hour_weekday")(lambda spark, sf: questions.hour_weekday(store(spark, sf), metric="avg_trip_distance"))
query("top_flows")(lambda spark, sf: questions.flows(store(spark, sf), limit=50))
query("dist_distance")(lambda spark, sf: questions.histogram(store(spark, sf), "trip_distance"))
query("dist_amount")(
    lambda spark, sf: questions.histogram(store(spark, sf), "total_amount")
)


@query("quantile_bucket")
def _(spark, sf):
    hist = questions.histogram(store(spark, sf), "total_amount")
    return questions.quantile_bucket(hist, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


query("dist_summary")(lambda spark, sf: questions.distribution_summary(store(spark, sf), "trip_distance"))


@query("explore_rows")
def _(spark, sf):
    page = questions.explore(
        store(spark, sf), TripFilter(weekday=(1, 2, 3)), sort="average_speed_mph", descending=False, quality="flagged",
        page=3, page_size=100,
    )
    return page.drop("source_file", "run_id")


@query("explore_deep_page")
def _(spark, sf):
    """A page far down by pickup time, from the days that a level says it lies on."""
    page = questions.explore(store_with_levels(spark, sf), TripFilter(hour=tuple(range(6, 22))), page=61, page_size=50)
    return page.drop("source_file", "run_id")


query("explore_count")(
    lambda spark, sf: questions.explore_count(store(spark, sf), LONG_TRIPS, flag="passenger_count_missing_or_zero")
)
query("zones_list")(lambda spark, sf: questions.zones_list(observed_zones(spark, sf)))
query("daily_quality")(lambda spark, sf: questions.daily_quality(store(spark, sf)))


def run_records(spark, sf) -> DataFrame:
    return inputs.runs(trips.annotated(spark, sf), inputs.schemas(spark, sf))


@query("quality_summary")
def _(spark, sf):
    runs = quality.quality_periods(run_records(spark, sf), store(spark, sf).periods)
    return quality.quality_totals(runs)


query("daily_flag_rate")(
    lambda spark, sf: questions.daily_flag_rate(questions.daily_quality(store(spark, sf)), "invalid_amount")
)
query("schema_fields")(lambda spark, sf: registry.field_availability(inputs.schemas(spark, sf)))
query("schema_versions")(lambda spark, sf: registry.schema_versions(inputs.schemas(spark, sf)))


def struct_text(column: str, *fields: str) -> Column:
    """An array of structs as text: fields joined by > and structs by ;."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(">", *[x[f] for f in fields])), ";").alias(column)


@query("schema_drift")
def _(spark, sf):
    drift = registry.schema_drift(inputs.schemas(spark, sf))
    return drift.select(
        "from_period", "to_period", "added", "removed", struct_text("renamed_case", "from", "to"),
        struct_text("type_changed", "column", "from", "to"), "changed",
    )


query("field_catalogue")(lambda spark, sf: registry.field_catalogue(registry.field_availability(inputs.schemas(spark, sf))))


# ---- insights -------------------------------------------------------------------------------------------------


def monthly(spark, sf, metric: str = "total_trips") -> DataFrame:
    return questions.time_series(store(spark, sf), metric=metric, grain="month")


query("series_change")(lambda spark, sf: insight.series_change(monthly(spark, sf)))


@query("series_summary")
def _(spark, sf):
    summary = insight.series_summary(questions.time_series(store(spark, sf), metric="total_recorded_amount"))

    def points(column: str) -> Column:
        return F.array_join(
            F.transform(column, lambda p: F.concat_ws("=", F.date_format(p["bucket"], "yyyy-MM-dd"), F.format_number(p["value"], 2))), ";"
        ).alias(column)

    return summary.select(
        "points", "highest_bucket", "highest", "lowest_bucket", "lowest", "mean", points("first_points"), points("last_points")
    )


query("largest_change")(lambda spark, sf: insight.largest_change(monthly(spark, sf)))
query("compare_periods")(
    lambda spark, sf: insight.compare_periods(
        store(spark, sf), Y1996, TripFilter(start=dt.date(1996, 7, 1), end=dt.date(1997, 6, 30))
    )
)
query("zones_share")(lambda spark, sf: insight.zones_share(store(spark, sf), "dropoff", limit=25))
query("breakdown_share")(lambda spark, sf: insight.breakdown_share(store(spark, sf), "payment_type", metric="avg_trip_distance"))
query("weekday_per_day")(lambda spark, sf: insight.weekday_per_day(store(spark, sf)))
query("weekend_split")(lambda spark, sf: insight.weekend_split(store(spark, sf)))
query("busiest_buckets")(lambda spark, sf: insight.busiest_buckets(questions.histogram(store(spark, sf), "total_amount")))


@query("quality_window")
def _(spark, sf):
    return insight.quality_window(
        run_records(spark, sf), store(spark, sf).periods, F.lit(dt.date(1996, 2, 10)), F.lit(dt.date(1997, 3, 5))
    )


query("anomaly_days")(lambda spark, sf: insight.anomaly_days(store(spark, sf), metric="avg_total_amount"))
query("anomaly_scores")(
    lambda spark, sf: insight.anomaly_scores(
        questions.daily(store(spark, sf)).select("pickup_date", F.col("trips").alias("value"))
    )
)
query("find_zones")(lambda spark, sf: questions.find_zones(observed_zones(spark, sf), " East"))
query("hour_extremes")(lambda spark, sf: insight.hour_extremes(store(spark, sf)))


# ---- reports --------------------------------------------------------------------------------------------------


def report_input(spark, sf, f: TripFilter = Y1997, grain: str = "day") -> report.ReportInput:
    s = store(spark, sf)
    return report.ReportInput(s, f, s.periods, run_records(spark, sf), inputs.schemas(spark, sf), MIN_GROUP, grain)


def written_report_input(spark, sf) -> report.ReportInput:
    """The same over tables that are written first, as published ones are: a whole report asks them many things."""
    annotated = cut(trips.annotated(spark, sf), "annotated")
    fact = cut(clean.accepted(annotated), "fact")
    periods = cut(quality.published_periods(fact), "periods")
    tables = TripStore.over(fact, cut(trips.zones(spark, sf), "zones"), periods)
    schemas = cut(inputs.schemas(spark, sf), "schemas")
    runs = cut(inputs.runs(annotated, schemas), "runs")
    return report.ReportInput(tables, Y1997, periods, runs, schemas, MIN_GROUP)


def whole_report(spark, sf, template: str) -> DataFrame:
    r = written_report_input(spark, sf)
    return report.tidy_report(r, template, r.periods.agg(F.min("min_pickup_date")).scalar())


def coverage_start(spark, sf) -> Column:
    return store(spark, sf).periods.agg(F.min("min_pickup_date")).scalar()


query("rpt_kpis")(
    lambda spark, sf: report.kpis(report_input(spark, sf), "executive_overview", coverage_start(spark, sf))
)
for _name, _table in {
    "rpt_trend": report.trend,
    "rpt_weekday": report.weekday,
    "rpt_zone_table": lambda r: report.zone_table(r, "pickup"),
    "rpt_payment": report.payment,
    "rpt_payment_top": report.payment_top,
    "rpt_quality_snapshot": report.quality_snapshot,
    "rpt_hour": report.hour,
    "rpt_heatmap": report.heatmap,
    "rpt_peak_slots": report.peak_slots,
    "rpt_distribution": lambda r: report.distribution(r, "total_amount"),
    "rpt_amount_by_hour": report.amount_by_hour,
    "rpt_exclusions": report.exclusions,
    "rpt_boroughs": report.boroughs,
    "rpt_flows": report.flow_table,
    "rpt_quality_kpis": report.quality_kpis,
    "rpt_processing": report.processing,
    "rpt_quarantine": report.quarantine,
    "rpt_flags": report.flags,
    "rpt_daily_flags": report.daily_flags,
}.items():
    query(_name)(lambda spark, sf, build=_table: build(report_input(spark, sf)))

LONG_RANGE = TripFilter(start=dt.date(1996, 3, 1), end=dt.date(1999, 2, 28))
query("rpt_trend_monthly")(lambda spark, sf: report.trend(report_input(spark, sf, LONG_RANGE, "month")))
query("rpt_schema")(lambda spark, sf: report.schema_changes(report_input(spark, sf, LONG_RANGE)))
query("rpt_evidence")(
    lambda spark, sf: report.evidence(written_report_input(spark, sf), [n for n, s in report.SECTIONS.items() if s.found])
)
for _name, _template in {
    "report_tidy": "demand_patterns",
    "report_executive_overview": "executive_overview",
    "report_fares_distance": "fares_distance",
    "report_zone_analysis": "zone_analysis",
    "report_data_quality": "data_quality",
}.items():
    query(_name)(lambda spark, sf, template=_template: whole_report(spark, sf, template))


# ---- claims and scorecard -------------------------------------------------------------------------------------


def store_with_hours(spark, sf) -> TripStore:
    """The store with its hourly rollup written, from which the days are taken more than once."""
    s = store(spark, sf)
    return replace(s, hourly=cut(s.hourly, "hourly"))


def all_claims(spark, sf, s: TripStore | None = None) -> DataFrame:
    return claims.extract_claims(inputs.claim_texts(spark, sf, s or store(spark, sf)))


query("extract_claims")(all_claims)
query("claim_candidates")(lambda spark, sf: claims.claim_candidates(cut(inputs.claim_values(store(spark, sf)), "values")))


@query("verify_claims")
def _(spark, sf):
    s = store_with_hours(spark, sf)
    found = cut(all_claims(spark, sf, s), "claims")
    return claims.verify_claims(found, cut(inputs.claim_values(s), "values"))


@query("number_groups")
def _(spark, sf):
    """Numbers of nested results: one result per month with its KPIs and a list of daily points."""
    days = questions.daily(store(spark, sf)).withColumn("run", inputs.month_index(F.col("pickup_date")))
    point = F.struct(
        F.col("pickup_date").cast("string").alias("day"), F.col("trips").alias("trips"),
        (F.col("trips") > 20).alias("busy"),
    )
    nested = days.groupBy("run").agg(
        F.struct(F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("days")).alias("kpis"),
        F.collect_list(point).alias("points"),
        F.struct(F.min("trips").alias("period_a"), F.max("trips").alias("period_b")).alias("compared"),
    )
    return claims.number_groups(nested, "run")


def scored(spark, sf) -> DataFrame:
    return scorecard.score_cases(inputs.cases(spark, sf), inputs.TOOL_DEFAULTS)


@query("grounding_rate")
def _(spark, sf):
    """Every document, turn and report sentence as an answer, its figures checked against the results of its run."""
    s = store_with_hours(spark, sf)
    found = cut(all_claims(spark, sf, s), "claims")
    checked = claims.verify_claims(found, cut(inputs.claim_values(s), "values"))
    answers = inputs.claim_texts(spark, sf, s).select(
        "id", (F.col("run") % 3).alias("repeat"), F.lit("data").alias("kind"), F.lit("answered").alias("status")
    )
    return scorecard.grounding_rate(scorecard.with_figures(answers, checked), "repeat")


@query("score_cases")
def _(spark, sf):
    return scored(spark, sf).select(
        "conv_id", "kind", "status", "tools", "tool_errors", "tool_ok", "args_ok", "text_ok", "clarified", "injection_ok",
        "forbidden_matched",
    )


@query("score_summary")
def _(spark, sf):
    return scorecard.score_summary(scored(spark, sf), "repeat")


@query("score_spread")
def _(spark, sf):
    summary = scorecard.score_summary(scored(spark, sf), "repeat")
    rates = ["answered_rate", "tool_selection_accuracy", "expected_text_rate", "failures", "latency_s_median", "model_calls_mean"]
    return scorecard.score_spread(summary, rates)


# ---- scalar functions, over days of trips ---------------------------------------------------------------------


def days(spark, sf) -> DataFrame:
    """One row per day: trips, valid amounts, the day before's trips, and the month's trips."""
    from pyspark.sql import Window

    frame = questions.daily(store(spark, sf))
    month = Window.partitionBy(F.trunc("pickup_date", "month"))
    return frame.select(
        "pickup_date", "trips", F.col("total_amount_valid_sum").cast("double").alias("usd"),
        F.col("trip_distance_valid_sum").alias("miles"), F.col("trip_duration_valid_sum").alias("minutes"),
        (F.col("trips") - F.col("amount_valid_trips")).alias("left_out"),
        F.lag("trips").over(month.orderBy("pickup_date")).alias("before"),
        F.sum("trips").over(month).alias("month_trips"),
    )


@query("fn_share")
def _(spark, sf):
    part, whole = F.col("trips"), F.when(F.dayofmonth("pickup_date") == 1, 0).otherwise(F.col("month_trips"))
    return days(spark, sf).select("pickup_date", numbers.share(part, whole).alias("share"))


@query("fn_change")
def _(spark, sf):
    base = F.col("before") - F.lit(20)
    return days(spark, sf).select(
        "pickup_date", numbers.change(F.col("trips"), base).alias("change"),
        numbers.change_on_size(F.col("trips"), base).alias("change_on_size"),
    )


@query("fn_percent")
def _(spark, sf):
    ratio = numbers.share(F.col("trips"), F.col("month_trips"))
    return days(spark, sf).select(
        "pickup_date", numbers.percent(ratio).alias("percent"), numbers.percent(ratio / 1000).alias("small"),
        numbers.percent(1 - ratio / 1000).alias("near_one"), numbers.percent(ratio / 10).alias("tenth"),
    )


@query("fn_signed_change")
def _(spark, sf):
    ratio = numbers.change(F.col("trips"), F.col("before"))
    return days(spark, sf).select(
        "pickup_date", numbers.signed_change(ratio).alias("change"), numbers.signed_change(ratio / 100).alias("small")
    )


@query("fn_display")
def _(spark, sf):
    c = F.col
    return days(spark, sf).select(
        "pickup_date",
        numbers.display(c("trips") * 1000, "trips").alias("trips"),
        numbers.display(c("usd") - 3000, "usd").alias("usd"),
        numbers.display(c("miles"), "miles").alias("miles"),
        numbers.display(c("minutes"), "minutes").alias("minutes"),
        numbers.display(c("minutes") / 7, "seconds").alias("seconds"),
        numbers.display(c("trips") / c("month_trips"), "share").alias("share"),
        numbers.display(c("trips") * c("month_trips") * 100, "bytes").alias("bytes"),
        numbers.display(c("before"), "count").alias("before"),
    )


@query("fn_labels")
def _(spark, sf):
    c = F.col
    rows = clean.annotated_rows(trips.annotated(spark, sf))
    tagged = rows.select(
        "payment_type", "vendor_id", "pickup_day_of_week", F.explode_outer("quarantine_reasons").alias("reason"),
        "quality_flags",
    ).select("*", F.explode_outer("quality_flags").alias("flag"))
    groups = tagged.groupBy("payment_type", "vendor_id", "pickup_day_of_week", "reason", "flag").agg(F.count(F.lit(1)).alias("rows"))
    return groups.select(
        labels.payment_label(c("payment_type") + 1).alias("payment"), labels.vendor_label(c("vendor_id")).alias("vendor"),
        labels.weekday_label(c("pickup_day_of_week")).alias("weekday"), labels.reason_label(c("reason")).alias("reason"),
        labels.flag_label(c("flag")).alias("flag"), "rows",
    )


@query("fn_period")
def _(spark, sf):
    day = F.col("pickup_date")
    start, end = F.lit(dt.date(1996, 1, 15)), F.lit(dt.date(1997, 2, 10))
    return days(spark, sf).select(
        "pickup_date", dates.yyyymm(day).alias("yyyymm"), dates.month_start(day).alias("month_start"),
        dates.month_end_exclusive(day).alias("month_end"), dates.month_label(day).alias("label"),
        dates.overlaps(dates.month_start(day), F.last_day(day), start, end).alias("overlaps"),
        dates.window_start(day, 30).alias("window_start"),
    )


@query("fn_date_words")
def _(spark, sf):
    day = F.col("pickup_date")
    later = F.date_add(day, (F.col("trips") % 40).cast("int"))
    return days(spark, sf).select(
        "pickup_date", dates.date_words(day).alias("words"), dates.date_range(day, later).alias("range"),
        dates.span_words(day, later).alias("span"),
    )


