"""From monthly source files to published tables, many months in one job.

Layout under one root: `fact`, `quarantine` and the four rollups each hold one folder per publication, and in it
months as partitions; `periods` says which publication every month is read from. Publishing therefore copies
nothing: tables are written once under a new publication, verified there, and one append to `periods` makes all
of them visible together. The latest row of a month counts, so a rerun replaces, and publishers that overlap lose
nothing of each other. Runs count as history once a month of their publication is in `periods`.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import clean, quality, rollups
from farebox.plans.route import TripStore
from farebox.schema import FIELD_NAMES, Rules
from farebox.session import DROP_SHUFFLES, cut, prepare, settings
from farebox.sources import files
from farebox.sources.mapping import map_schema
from farebox.sources.zones import check_zones

PARTITION = ("taxi_type", "data_period")
ROWS_PER_FILE = 1_000_000  # fixed value: most rows of one curated file
MIN_TASK_ROWS = 50_000  # below this another writing task is not worth its file
OPEN_MONTHS = 16  # months a task has open at once where its rows are not sorted; with more of them Spark sorts the rest
MAX_WRITE_TASKS = 20_000  # above this, tasks write several files instead of there being more tasks


@dataclass(frozen=True)
class Source:
    """One monthly file (or a folder of part files) and what it holds."""

    key: str
    taxi_type: str
    period: str  # YYYY-MM
    path: str
    file_format: str = "parquet"
    timestamp_pattern: str | None = None
    run_id: str = ""


# ---- reading many months --------------------------------------------------------------------------------------


def with_identity(df: DataFrame, source: Source) -> DataFrame:
    """Source keys from the manifest; constants of the scan, so they cost nothing and prune nothing away."""
    return df.drop("source_path").withColumns(
        {
            "taxi_type": F.lit(source.taxi_type),
            "data_period": F.lit(f"{source.period}-01").cast("date"),
            "source_file": F.lit(source.path.rstrip("/").rsplit("/", 1)[-1]),
            "run_id": F.lit(source.run_id),
        }
    )


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """One source as normalized rows; schema problems are raised before any row is read."""
    if source.file_format == "parquet":
        raw = files.read_parquet(spark, source.path)
    elif source.file_format == "csv":
        header = files.read_header(spark, source.path)
        files.check_header(header)
        raw = files.read_csv(spark, source.path, header)
    else:
        raise ValueError(f"unsupported source format {source.file_format!r}")
    mapping = map_schema(source.taxi_type, raw.drop("source_path").schema)
    return clean.normalize(with_identity(raw, source), mapping, source.timestamp_pattern)


def read_sources(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """All sources as one frame. Different source schemas meet only after normalization."""
    frames = [read_source(spark, s) for s in sources]
    if not frames:
        raise ValueError("no sources")
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


REGISTRY = (
    "taxi_type string, period string, source_key string, file_format string, schema_version string, "
    "columns map<string,string>, by_field map<string,string>, unavailable array<string>, run_id string, "
    "available array<string>, input_bytes long"
)


def registry_rows(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The schema each source was received with, its size, and the run that reads it, for the schema registry."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = []
    for source in sources:
        if source.file_format == "parquet":
            schema = files.read_parquet(spark, source.path).drop("source_path").schema
        else:
            schema = files.text_schema(files.read_header(spark, source.path))
        found = map_schema(source.taxi_type, schema)
        size = listed.load(source.path).agg(F.sum("length")).first()[0]  # sizes only; no content is read
        rows.append((
            source.taxi_type, source.period, source.key, source.file_format, found.version, found.columns,
            found.by_field, list(found.unavailable), source.run_id, list(found.by_field), size,
        ))
    return spark.createDataFrame(rows, REGISTRY)


def registry_row(spark: SparkSession, source: Source) -> DataFrame:
    return registry_rows(spark, [source])


# ---- writing --------------------------------------------------------------------------------------------------


def write_tasks(rows: int, rows_per_file: int = ROWS_PER_FILE, cores: int = 1) -> int:
    """One task per full file; on a small table enough to keep the cores busy."""
    files_needed = math.ceil(rows / rows_per_file)
    busy = min(cores, math.ceil(rows / MIN_TASK_ROWS))
    return max(1, min(max(files_needed, busy), MAX_WRITE_TASKS))


def write_curated(
    df: DataFrame, path: str, rows: int, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite"
) -> None:
    """Accepted rows by month, range-partitioned and sorted by pickup time, at most `rows_per_file` per file.

    The last range key spreads trips that share one pickup time, so a crowded instant is split as well.
    """
    spread = F.xxhash64("dropoff_datetime", "pickup_location_id", "dropoff_location_id", "total_amount", "trip_distance")
    tasks = write_tasks(rows, rows_per_file, df.sparkSession.sparkContext.defaultParallelism)
    order = [*PARTITION, "pickup_datetime", spread]  # the hash is worked out at either end, not shuffled with the rows
    writer = (
        df.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy(*PARTITION)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
    )
    with settings(df.sparkSession, **{DROP_SHUFFLES: "true"}):
        writer.parquet(path)


def write_partitions(df: DataFrame, path: str, rebalance: bool = True) -> None:
    """Replace exactly the months present in `df`; other months are untouched, a rerun never appends.

    Rows of a month are brought together first, so tasks do not each write a sliver of every month; adaptive
    execution splits a month that is too big for one task and joins those that are small.
    """
    grouped = df.hint("rebalance", *[F.col(c) for c in PARTITION]) if rebalance else df
    writer = (
        grouped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*PARTITION)
    )
    # Rows that come month by month need no sort, which would hold or spill all that a task reads; a few open months do.
    unsorted = {} if rebalance else {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_MONTHS)}
    with settings(df.sparkSession, **{DROP_SHUFFLES: "true"}, **unsorted):
        writer.parquet(path)


def write_quarantine(annotated: DataFrame, path: str) -> None:
    write_partitions(clean.quarantined(annotated), path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in a folder, or nothing where there is no folder or no file in it; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def publish(staged: DataFrame, target: str) -> DataFrame:
    """Replace the staged months in `target` and return the reconciliation of what is there now.

    A stage that is empty or holds rows outside their month is refused before anything is replaced; if what was
    written then differs from the stage, an error says so.
    """
    if staged.isEmpty():
        raise quality.VerificationError("an empty period is not published")
    spark = staged.sparkSession
    quality.require(quality.verify_stage(staged), "stage")
    write_partitions(staged, target, rebalance=False)  # staged files are already one month each, sorted
    months = F.broadcast(staged.select(*PARTITION).distinct())  # one small row per month
    now = spark.read.parquet(target).join(months, list(PARTITION), "left_semi")
    checked = quality.verify_published(now, staged)
    quality.require(checked, "published")
    return checked


# ---- small versioned tables -----------------------------------------------------------------------------------


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version, then append the pointer that makes it current. Readers never see half a table."""
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
    df.write.parquet(f"{path}/{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/_current")
    return version


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    pointers = read_table(spark, f"{path}/_current")
    if pointers is None:
        return None
    return spark.read.parquet(f"{path}/{pointers.agg(F.max('version')).first()[0]}")


def append_periods(periods: DataFrame, root: str) -> None:
    """Add period rows; one file, so all of them appear together. Nothing is read or rewritten, so publishers that
    overlap can't undo each other."""
    periods.coalesce(1).write.mode("append").parquet(f"{root}/periods")  # one row per month


def current_periods(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest row of every month."""
    rows = read_table(spark, f"{root}/periods")
    return None if rows is None else quality.latest_periods(rows)


def record_run(root: str, records: DataFrame, periods: DataFrame, schemas: DataFrame | None = None) -> None:
    """Add the run rows and schemas, then the periods: the step that makes months visible, and the runs history."""
    records.write.mode("append").parquet(f"{root}/runs")
    if schemas is not None:
        schemas.write.mode("append").parquet(f"{root}/schemas")
    append_periods(periods, root)


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """Records of the runs whose publication became visible; those of a job that failed at the last step don't count."""
    made = spark.read.parquet(f"{root}/periods").select("publication").distinct()
    return spark.read.parquet(f"{root}/runs").join(made, "publication", "left_semi")


def published_schemas(spark: SparkSession, root: str) -> DataFrame:
    """The schema registry: of each month's published runs, the schema its source had."""
    runs = published_runs(spark, root).select("run_id").distinct()
    return spark.read.parquet(f"{root}/schemas").join(runs, "run_id", "left_semi")


# ---- publications ---------------------------------------------------------------------------------------------

TABLES: tuple[str, ...] = ("fact", *rollups.ROLLUPS)
# Tables a publication may lack, where nothing was flagged or no value was valid.
SPARSE = {
    "buckets": "taxi_type string, pickup_date date, metric string, bucket_start double, trips long, run_id string, "
    "publication string, data_period date",
    "flags_daily": "taxi_type string, pickup_date date, flag string, flagged_trips long, run_id string, "
    "publication string, data_period date",
}


def new_publication() -> str:
    return f"p{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"


def folder(root: str, table: str, publication: str) -> str:
    return f"{root}/{table}/publication={publication}"


def read_publications(spark: SparkSession, root: str, table: str, months: dict[str, list[date]]) -> DataFrame:
    """The given months of the given publications, by partition filters; other publications are not even listed."""
    there = sorted(months)
    if table in SPARSE:  # a publication without such rows may have no folder
        there = [p for p in there if read_table(spark, folder(root, table, p)) is not None]
        if not there:
            return spark.createDataFrame([], SPARSE[table])
    df = spark.read.option("basePath", f"{root}/{table}").parquet(*[folder(root, table, p) for p in there])
    current = [
        (F.col("publication") == p) & F.col("data_period").isin(*sorted(periods)) for p, periods in months.items()
    ]
    return df.filter(reduce(lambda a, b: a | b, current))


def build_rollups(fact: DataFrame, root: str, publication: str) -> dict[str, DataFrame]:
    """The four rollups of the given trips under a publication, and the levels made of them, read back as written."""
    spark, runs = fact.sparkSession, rollups.Runs(fact)
    frames = {}
    for name, build in rollups.ROLLUPS.items():
        write_partitions(runs.named(build(runs.numbered(fact))), folder(root, name, publication))
        written = read_table(spark, folder(root, name, publication))
        frames[name] = spark.createDataFrame([], SPARSE[name]).drop("publication") if written is None else written
    levels = runs.named(rollups.level_rows({n: runs.numbered(f) for n, f in frames.items()}))
    levels = levels.hint("rebalance", F.col("level"))  # few rows, so one folder per level, not month
    with settings(spark, **{DROP_SHUFFLES: "true"}):
        levels.write.option("compression", "zstd").partitionBy("level").parquet(folder(root, "levels", publication))
    return frames


def with_level_rows(spark: SparkSession, periods: DataFrame, root: str, publication: str) -> DataFrame:
    """Period rows with the number of rows each level has for their month, by which questions find the smallest."""
    written = spark.read.parquet(folder(root, "levels", publication))
    counted = written.groupBy(*PARTITION, "level").agg(F.count(F.lit(1)).alias("rows"))
    sizes = counted.groupBy(*PARTITION).agg(F.map_from_entries(F.collect_list(F.struct("level", "rows"))).alias("level_rows"))
    return periods.drop("level_rows").join(sizes, list(PARTITION), "left")


def level_sizes(periods: DataFrame) -> dict[str, int]:
    """Rows of each level over the given periods; none if a period was published before there were levels."""
    if "level_rows" not in periods.columns or not periods.where("level_rows IS NULL").isEmpty():
        return {}
    rows = periods.select(F.explode("level_rows").alias("level", "rows")).groupBy("level").agg(F.sum("rows").alias("rows"))
    return {r.level: r.rows for r in rows.collect() if r.level in rollups.LEVELS}


def verify_tables(fact: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    return quality.verify_rollups(fact, frames["hourly"], frames["dropoff_daily"], frames["buckets"])


# ---- the whole job --------------------------------------------------------------------------------------------


def publish_normalized(
    spark: SparkSession,
    rows: DataFrame,
    zones: DataFrame,
    root: str,
    rules: Rules = Rules(),
    ingested_at: Column | None = None,
    schemas: DataFrame | None = None,
) -> DataFrame:
    """Normalized rows of any number of months to published tables; returns the run records.

    `schemas` are the registry rows of the sources (see registry_rows). They say which fields a run's source has: only
    those count as missing or unreadable. Without them every field counts, and a run has no schema version.

    The annotated trips are written once to the shared folder, in order of time, and read from there by every later
    step: the cleaning shuffle runs once, and a lost executor costs a re-read, not a recomputation.
    """
    prepare(spark)
    started, publication = time.time(), new_publication()
    annotated = clean.with_ingest_time(clean.annotate(clean.collapse_unordered(rows), zones, rules), ingested_at)
    annotated = clean.ordered(cut(annotated.sortWithinPartitions(*PARTITION, "pickup_datetime"), "annotated"))
    metrics = cut(quality.run_metrics(annotated), "metrics")
    total = metrics.agg(F.sum("accepted_rows")).first()[0] or 0
    if not total:
        raise quality.VerificationError("an empty period is not published")

    write_curated(clean.accepted(annotated), folder(root, "fact", publication), total)
    fact = spark.read.parquet(folder(root, "fact", publication))
    quality.require(quality.verify_staged(fact, metrics), "fact")
    frames = build_rollups(fact, root, publication)
    quality.require(verify_tables(fact, frames), "rollup")
    write_partitions(clean.quarantined(annotated), folder(root, "quarantine", publication))

    if schemas is None:
        known = metrics.withColumns({
            "available": F.array(*map(F.lit, FIELD_NAMES)), "schema_version": F.lit(None).cast("string"),
            "input_bytes": F.lit(None).cast("long"),
        })
    else:
        known = metrics.join(schemas.select("run_id", "available", "schema_version", "input_bytes"), "run_id", "left")
    facts = known.select(F.col("run_id").alias("run"), "schema_version", "input_bytes")
    records = quality.run_record(known, F.col("available"))
    records = records.join(facts, records.run_id == facts.run, "left").drop("run").withColumns(
        {
            "started_at": F.timestamp_seconds(F.lit(started)),
            "error": F.lit(None).cast("string"),
            "publication": F.lit(publication),
            "duration_seconds": F.lit(round(time.time() - started, 3)),
            "status": F.lit("succeeded"),
            "completed_at": F.current_timestamp(),
        }
    )
    runs = rollups.Runs(fact)
    periods = runs.named(quality.published_periods(runs.numbered(fact))).withColumns(
        {
            "publication": F.lit(publication),
            "rollup_publication": F.lit(publication),
            "published_at": F.current_timestamp(),
        }
    )
    periods = with_level_rows(spark, periods, root, publication)
    records = cut(records, "records")
    record_run(root, records, periods, schemas)
    return records


def publish_months(
    spark: SparkSession, sources: Sequence[Source], zones: DataFrame, root: str, rules: Rules = Rules()
) -> DataFrame:
    """All given sources in one application. CSV files are checked first; a bad one publishes nothing."""
    for source in sources:
        if source.file_format == "csv":
            files.require_valid_csv(spark, source.path)
    run = uuid.uuid4().hex[:12]
    named = [s if s.run_id else replace(s, run_id=f"{run}-{s.key}") for s in sources]
    check_zones(zones)
    return publish_normalized(
        spark, read_sources(spark, named), zones, root, rules, schemas=registry_rows(spark, named)
    )


def published_months(spark: SparkSession, root: str, taxi_type: str | None = None) -> DataFrame:
    periods = current_periods(spark, root)
    if periods is None:
        raise LookupError("nothing is published yet")
    return periods if taxi_type is None else periods.filter(F.col("taxi_type") == taxi_type)


def by_publication(periods: DataFrame, column: str) -> dict[str, list[date]]:
    """Months per publication, on the driver: one small row per published month."""
    found: dict[str, list[date]] = {}
    for row in periods.select(column, "data_period").collect():
        found.setdefault(row[0], []).append(row[1])
    return found


def rebuild_rollups(spark: SparkSession, root: str, months: Iterable[date] | None = None) -> DataFrame:
    """Rebuild the rollups of published months from the fact, in one job; rows per month and table."""
    prepare(spark)
    periods = published_months(spark, root)
    if months is not None:
        periods = periods.filter(F.col("data_period").isin(*months))
    fact = read_publications(spark, root, "fact", by_publication(periods, "publication")).drop("publication")
    publication = new_publication()
    frames = build_rollups(fact, root, publication)
    quality.require(verify_tables(fact, frames), "rollup")
    renewed = periods.withColumns(
        {"rollup_publication": F.lit(publication), "published_at": F.current_timestamp()}
    )
    append_periods(with_level_rows(spark, renewed, root, publication), root)
    return rollup_rows(frames)


def rollup_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """(data_period, table, rows) of the given rollups."""
    counted = [
        frame.groupBy("data_period").agg(F.count(F.lit(1)).alias("rows")).select(
            "data_period", F.lit(name).alias("table"), "rows"
        )
        for name, frame in frames.items()
    ]
    whole = counted[0]
    for frame in counted[1:]:
        whole = whole.unionByName(frame)
    return whole


def open_store(spark: SparkSession, root: str, taxi_type: str = "yellow", zones: DataFrame | None = None) -> TripStore:
    """The published tables of one taxi type, limited to its published months by partition filters."""
    prepare(spark)
    periods = published_months(spark, root, taxi_type)
    of_fact, of_rollups = (by_publication(periods, c) for c in ("publication", "rollup_publication"))
    tables = {
        name: read_publications(spark, root, name, of_fact if name == "fact" else of_rollups).filter(
            F.col("taxi_type") == taxi_type
        )
        for name in TABLES
    }
    zones = zones if zones is not None else current_table(spark, f"{root}/zones")
    sizes = level_sizes(periods)
    levels = {}
    if sizes:
        rows = read_publications(spark, root, "levels", of_rollups).filter(F.col("taxi_type") == taxi_type)
        levels = {name: rows.filter(F.col("level") == name) for name in sizes}
    return TripStore(**tables, zones=zones, periods=periods, levels=levels, level_sizes=sizes)
