"""Session set-up and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_SCOPE: ContextVar[list[str] | None] = ContextVar("staging_scope", default=None)


def build_session(app_name: str = "tiltmeter", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling on; `conf` wins over these defaults."""
    settings: dict[str, object] = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by the session.

    Only a local master may fall back to a folder of its own; on a cluster that folder would exist on one
    machine and a lost executor would take the data with it.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tiltmeter-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write `df` once, in one folder per value of `by`, and read it back.

    This cuts the lineage on storage that outlives executors, keeps later scans column-pruned, and gives the
    optimizer the real size of the table, so it broadcasts a staged side only when that size allows it.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block when it ends; their readers must be done by then."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
