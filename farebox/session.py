"""Session settings every job relies on, and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Wall-clock timestamps are TIMESTAMP_NTZ; casts to and from TIMESTAMP use the session zone, so it is pinned.
PINNED = {"spark.sql.session.timeZone": "UTC"}
# Spark's own setting: what a job has shuffled goes from the executors' disks when the job ends, not when the driver
# happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}  # local tests only: one temporary folder per application


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results; leaves sizing (memory, shuffle partitions) to the caller."""
    for key, value in PINNED.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def build(app: str = "farebox", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        **PINNED,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **extra}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the cluster names none (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _LOCAL_FOLDERS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(
            prefix="farebox-"
        )
        _LOCAL_FOLDERS[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/farebox/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """These session settings for the jobs run inside; then the earlier ones again."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lineage cut that outlives lost executors.

    What the write has shuffled is dropped when it ends, so a job of many steps takes the disk of its largest step.
    """
    path = scratch_path(df.sparkSession, label)
    with settings(df.sparkSession, **{DROP_SHUFFLES: "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
