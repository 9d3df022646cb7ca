"""Run-quality numbers, their reconciliation with what was written, and the metadata built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.operators.clean import is_accepted, is_kept
from farebox.schema import FIELD_NAMES, FLAGS, REASONS, WIDE_MONEY
from farebox.session import cut

RUN_KEYS: tuple[str, ...] = ("taxi_type", "data_period", "run_id")
COUNTS: tuple[str, ...] = (
    "input_rows",
    "accepted_rows",
    "quarantined_rows",
    "duplicate_rows",
    "invalid_timestamp_rows",
    "unmapped_location_rows",
)


def weighted(condition: Column, rows: Column) -> Column:
    """Rows for which `condition` holds; nothing counted is 0."""
    return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0)).cast("long")


def tally(names: Sequence[str], count: Callable[[str], Column]) -> Column:
    """Map of name to its count, all counted in the same aggregation; a name nothing counted for has 0."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[count(n) for n in names]))


def run_metrics(annotated: DataFrame, by: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Every count of a run in one grouped aggregation, for all runs at once; detailed counts are maps.

    Works on distinct trips weighted by their copies; combines before the shuffle, so one row per run and
    task crosses the network.
    """
    copies = F.col("_copies")
    repeats = F.coalesce(F.sum(copies - is_kept().cast("long")), F.lit(0)).cast("long")  # copies after the kept one
    published = is_accepted()

    def with_reason(*names: str) -> Column:
        return weighted(F.arrays_overlap("_row_reasons", F.array(*map(F.lit, names))), copies)

    def with_flag(*names: str) -> Column:
        return F.count_if(published & F.arrays_overlap("quality_flags", F.array(*map(F.lit, names))))

    def of_published(column: str) -> Column:
        return F.when(published, F.col(column))

    return annotated.groupBy(*by).agg(
        F.coalesce(F.sum(copies), F.lit(0)).cast("long").alias("input_rows"),
        F.count_if(published).alias("accepted_rows"),
        (F.count_if(is_kept() & ~published) + repeats).alias("quarantined_rows"),
        repeats.alias("duplicate_rows"),
        with_reason(*REASONS[:2]).alias("invalid_timestamp_rows"),
        with_flag(*FLAGS[5:]).alias("unmapped_location_rows"),
        F.sum(of_published("total_amount")).cast(WIDE_MONEY).alias("accepted_amount"),
        F.min(of_published("pickup_date")).alias("min_pickup_date"),
        F.max(of_published("pickup_date")).alias("max_pickup_date"),
        tally(REASONS, lambda n: repeats if n == REASONS[3] else with_reason(n)).alias("reason_rows"),
        tally(FLAGS, with_flag).alias("flag_rows"),
        tally(FIELD_NAMES, lambda n: weighted(F.col(n).isNull(), copies)).alias("null_rows"),
        tally(FIELD_NAMES, lambda n: weighted(F.array_contains("_cast_failures", n), copies)).alias("unread_rows"),
    )


def _tall(metrics: DataFrame, counts: str, keys: Sequence[str], label: str, names: Sequence[str]) -> DataFrame:
    rows = metrics.select(*keys, F.explode(counts).alias(label, "rows"))
    return rows.filter(F.col(label).isin(*names))


def reason_counts(metrics: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return _tall(metrics, "reason_rows", keys, "reason", REASONS)


def flag_counts(metrics: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return _tall(metrics, "flag_rows", keys, "flag", FLAGS)


def cast_failure_counts(
    metrics: DataFrame, available: Sequence[str] = FIELD_NAMES, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    return _tall(metrics, "unread_rows", keys, "field", available)


def percent_of(part: Column, rows: Column) -> Column:
    return F.round(100.0 * F.try_divide(part, rows), 4)


def missingness(
    metrics: DataFrame, available: Sequence[str] = FIELD_NAMES, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """NULLs and their share of the rows read, per field the source has."""
    rows = _tall(metrics, "null_rows", [*keys, "input_rows"], "field", available)
    share = percent_of(F.col("rows"), F.col("input_rows"))
    return rows.select(*keys, "field", F.col("rows").alias("null_count"), share.alias("null_pct"))


def missing_by_field(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Months summed per field, most often missing first, with the share of all rows read."""
    whole = metrics.agg(F.sum("input_rows").alias("n")).scalar()
    summed = rows.groupBy("field").agg(F.sum("null_count").alias("null_count"))
    return summed.withColumn("share", F.try_divide(F.col("null_count").cast("double"), whole)).orderBy(
        F.desc("null_count"), "field"
    )


def run_record(metrics: DataFrame, available: Column | Sequence[str] = FIELD_NAMES) -> DataFrame:
    """The one-row-per-run quality record. Per-field numbers cover the fields a source has: `available` is a list for
    all runs, or a column of `metrics` with each run's own."""
    fields = available if isinstance(available, Column) else F.array(*map(F.lit, available))

    def of_source(counts: str) -> Column:
        return F.map_filter(counts, lambda name, _: F.array_contains(fields, name))

    missing = F.transform_values(
        of_source("null_rows"),
        lambda _, n: F.struct(n.alias("null_count"), percent_of(n, F.col("input_rows")).alias("null_pct")),
    )
    return metrics.select(
        *RUN_KEYS,
        *COUNTS,
        "accepted_amount",
        "min_pickup_date",
        "max_pickup_date",
        F.col("reason_rows").alias("quarantine_reasons"),
        F.col("flag_rows").alias("flags"),
        of_source("unread_rows").alias("cast_failures"),
        missing.alias("missingness"),
    )


# ---- reconciliation -------------------------------------------------------------------------------------------


class VerificationError(RuntimeError):
    """Numbers that must agree exactly do not."""


def checks(df: DataFrame, keys: Sequence[str], *named: tuple[str, Column, Column]) -> DataFrame:
    """(keys, check, expected, actual, ok) rows; a missing side is a failed check, never a skipped one."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                expected.cast(WIDE_MONEY).alias("expected"),
                actual.cast(WIDE_MONEY).alias("actual"),
                expected.cast(WIDE_MONEY).eqNullSafe(actual.cast(WIDE_MONEY)).alias("ok"),
            )
            for name, expected, actual in named
        ]
    )
    return df.select(*keys, F.inline(rows))


def require(checked: DataFrame, what: str) -> None:
    """Raise where a check failed. All failed checks are written to the shared folder; the error names the table and
    shows its first rows."""
    failed = cut(checked.filter(~F.col("ok")), f"failed-{what.replace(' ', '-')}-checks")
    shown = failed.limit(20).collect()
    if shown:
        detail = "; ".join(str(r.asDict()) for r in shown)
        where = failed.select("_metadata.file_path").first()[0].rsplit("/", 1)[0]
        raise VerificationError(f"{what} verification failed, {failed.count()} checks in {where}: {detail}")


def verify_staged(staged: DataFrame, metrics: DataFrame) -> DataFrame:
    """What was written against what the cleaning job counted: rows and exact amount of every period."""
    period = ["taxi_type", "data_period"]
    actual = staged.groupBy(*period).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).cast(WIDE_MONEY).alias("amount"),
        F.count_if(F.trunc("pickup_date", "month") != F.col("data_period")).alias("stray"),
    )
    expected = metrics.groupBy(*period).agg(
        F.sum("accepted_rows").alias("want_rows"),
        F.coalesce(F.sum("accepted_amount"), F.lit(0)).cast(WIDE_MONEY).alias("want_amount"),
    )
    both = expected.join(actual, period, "full")
    zero = F.lit(0)
    return checks(
        both,
        period,
        ("rows", F.coalesce("want_rows", zero), F.coalesce("rows", zero)),
        ("amount", F.coalesce("want_amount", zero), F.coalesce("amount", zero)),
        ("rows outside the period", zero, F.coalesce("stray", zero)),
        ("period is expected", F.lit(1), F.when(F.col("want_rows").isNotNull(), 1).otherwise(0)),
    )


def verify_stage(staged: DataFrame) -> DataFrame:
    """Rows of a stage that lie outside the month they would be published in."""
    period = ["taxi_type", "data_period"]
    stray = F.count_if(F.coalesce(F.trunc("pickup_date", "month") != F.col("data_period"), F.lit(True)))
    found = staged.groupBy(*period).agg(stray.alias("stray"))
    return checks(found, period, ("rows outside the period", F.lit(0), F.col("stray")))


def verify_published(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Target rows and sums equal the staged ones, period by period."""
    period = ["taxi_type", "data_period"]

    def totals(df: DataFrame, rows: str, amount: str) -> DataFrame:
        return df.groupBy(*period).agg(
            F.count(F.lit(1)).alias(rows),
            F.coalesce(F.sum("total_amount"), F.lit(0)).cast(WIDE_MONEY).alias(amount),
        )

    both = totals(staged, "want_rows", "want_amount").join(totals(target, "rows", "amount"), period, "full")
    return checks(
        both,
        period,
        ("rows", F.col("want_rows"), F.col("rows")),
        ("amount", F.col("want_amount"), F.col("amount")),
    )


def verify_rollups(fact: DataFrame, hourly: DataFrame, dropoff: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rollups account for every trip, every valid dollar and every valid distance of each month."""
    month = F.trunc("pickup_date", "month").alias("month")
    keys = ["taxi_type", "month"]
    zero = F.lit(0)
    base = fact.groupBy("taxi_type", month).agg(
        F.count(F.lit(1)).alias("trips"),
        F.coalesce(F.sum(F.when(F.col("is_amount_valid"), F.col("total_amount"))), zero).alias("amount"),
        F.count_if("is_distance_valid").alias("distances"),
    )

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("taxi_type", month).agg(
            F.sum("trips").alias(f"{name}_trips"), F.sum("total_amount_valid_sum").alias(f"{name}_amount")
        )

    bucketed = (
        buckets.filter(F.col("metric") == "trip_distance")
        .groupBy("taxi_type", month)
        .agg(F.sum("trips").alias("bucketed"))
    )
    joined = (
        base.join(totals(hourly, "hourly"), keys, "full")
        .join(totals(dropoff, "dropoff"), keys, "full")
        .join(bucketed, keys, "full")
    )
    return checks(
        joined,
        keys,
        ("hourly trips", F.col("trips"), F.col("hourly_trips")),
        ("hourly amount", F.col("amount"), F.col("hourly_amount")),
        ("drop-off trips", F.col("trips"), F.col("dropoff_trips")),
        ("drop-off amount", F.col("amount"), F.col("dropoff_amount")),
        ("distance buckets", F.col("distances"), F.coalesce("bucketed", zero)),
    )


# ---- published months and runs --------------------------------------------------------------------------------


def published_periods(fact: DataFrame) -> DataFrame:
    """One row per published month: rows, run and the dates it covers."""
    return fact.groupBy("taxi_type", "data_period").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("run_id").alias("run_id"),
        F.min("pickup_date").alias("min_pickup_date"),
        F.max("pickup_date").alias("max_pickup_date"),
    )


def latest_periods(rows: DataFrame) -> DataFrame:
    """The row of each (taxi type, month) published last."""
    latest = Window.partitionBy("taxi_type", "data_period").orderBy(F.desc("published_at"), F.desc("run_id"))
    return rows.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") == 1).drop("_n")


def coverage(periods: DataFrame) -> DataFrame:
    """Total coverage beside every month's own."""
    whole = Window.partitionBy("taxi_type")
    return periods.select(
        "taxi_type",
        F.min("min_pickup_date").over(whole).alias("start_date"),
        F.max("max_pickup_date").over(whole).alias("end_date"),
        F.sum("row_count").over(whole).alias("total_rows"),
        F.date_format("data_period", "yyyy-MM").alias("period"),
        "row_count",
        "run_id",
        "min_pickup_date",
        "max_pickup_date",
    ).orderBy("taxi_type", "period")


def overlapping(periods: DataFrame, start: Column, end: Column) -> DataFrame:
    """Months whose own dates overlap [start, end]; an open side is NULL."""
    before = F.coalesce(F.col("min_pickup_date") <= end, F.lit(True))
    after = F.coalesce(F.col("max_pickup_date") >= start, F.lit(True))
    return periods.filter(before & after)


def dataset_version(periods: DataFrame, start: Column, end: Column) -> DataFrame:
    """Fingerprint of the month:run pairs behind a range; one short string per month is gathered."""
    pairs = F.concat_ws(":", F.date_format("data_period", "yyyy-MM"), "run_id")
    text = F.array_join(F.sort_array(F.collect_list(pairs)), ";")
    return overlapping(periods, start, end).agg(
        F.substring(F.sha2(text, 256), 1, 12).alias("version"), F.count(F.lit(1)).alias("months")
    )


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n")


def source_status(manifest: DataFrame, files: DataFrame, periods: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each manifest source with its registered file, published month and latest job."""
    registered = files.select("source_key", "bytes", "sha256", "schema_version")
    months = periods.select(
        "taxi_type",
        F.date_format("data_period", "yyyy-MM").alias("period"),
        F.col("row_count").alias("published_rows"),
        F.col("run_id").alias("published_run"),
    )
    job = latest_per(jobs, "source_key", "created_at").select(
        "source_key", "job_id", F.col("status").alias("job_status"), F.col("created_at").alias("job_created_at")
    )
    return (
        manifest.join(registered, "source_key", "left")
        .join(months, ["taxi_type", "period"], "left")
        .join(job, "source_key", "left")
        .withColumn("checksum_pinned", F.col("expected_sha256").isNotNull())
        .orderBy("source_key")
    )


def run_history(
    jobs: DataFrame,
    runs: DataFrame,
    status: str | None = None,
    source_key: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest jobs first with their run's row counts; a job without a run keeps NULL counts."""
    chosen = jobs
    if status is not None:
        chosen = chosen.filter(F.col("status") == status)
    if source_key is not None:
        chosen = chosen.filter(F.col("source_key") == source_key)
    newest = chosen.orderBy(F.desc("created_at"), "job_id").limit(limit)
    counts = runs.select("run_id", "input_rows", "accepted_rows", "quarantined_rows")
    return newest.join(counts, "run_id", "left").orderBy(F.desc("created_at"), "job_id")


def quality_periods(runs: DataFrame, periods: DataFrame) -> DataFrame:
    """Run records of the published months only; where both name a publication, of that one, so that a month published
    again under the same run counts once."""
    keys = [*RUN_KEYS, *({"publication"} & {*runs.columns} & {*periods.columns})]
    return runs.join(periods.select(*keys), keys, "left_semi")


def quality_totals(runs: DataFrame) -> DataFrame:
    """(kind, name, rows): the run counts, reasons and flags summed over the given runs, in one pass."""
    counts = F.create_map(*[c for n in COUNTS[:4] for c in (F.lit(n), F.col(n))])

    def entries(kind: str, column: Column) -> Column:
        return F.transform(
            F.map_entries(column),
            lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("rows")),
        )

    tall = F.concat(
        entries("rows", counts), entries("reason", F.col("quarantine_reasons")), entries("flag", F.col("flags"))
    )
    return runs.select(F.inline(tall)).groupBy("kind", "name").agg(F.sum("rows").alias("rows"))
