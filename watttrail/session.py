"""Session defaults and shared storage for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects: UTC, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder and any other master a folder in
    the warehouse, which a cluster shares.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local"):
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-stage-")
        else:
            _own_dirs[app] = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{app}"
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries inside delete their shuffle files as they end, not when the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts lineage, fixes the result of expressions that depend on the partition, survives
    the loss of executors and lets the shuffle files behind ``df`` go.
    """
    path = new_path(df.sparkSession, label)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
