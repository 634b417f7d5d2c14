"""Writers: finished datasets, result tables, JSON lines, text reports and the scored-baseline table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.config import BASELINE
from tiltmeter.schemas import DATASET_ORDER


def finalize_dataset(df: DataFrame, default_mutation_type: str = BASELINE) -> DataFrame:
    """Fill defaults, add `text`, and put the known columns first."""
    if "tweet_text" in df.columns and "text" not in df.columns:
        df = df.withColumn("text", F.col("tweet_text"))
    kind = F.col("mutation_type") if "mutation_type" in df.columns else F.lit(None).cast("string")
    flag = F.col("is_synthetic") if "is_synthetic" in df.columns else F.lit(None).cast("boolean")
    df = df.withColumns({
        "mutation_type": F.coalesce(kind, F.lit(default_mutation_type)),
        "is_synthetic": F.coalesce(flag, F.lit(False)),
    })
    first = [c for c in DATASET_ORDER if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def save_datasets(df: DataFrame, path: str, *, mode: str = "overwrite", ordered: bool = True) -> None:
    """Long table to Parquet, one folder per dataset, time-ordered inside every file if `ordered`.

    Range partitioning on (dataset, time) keeps a large dataset in many files and a reader of one dataset or
    a time span in few. Without the order nothing is shuffled.
    """
    table = finalize_dataset(df)
    if ordered:
        keys = ["dataset", "timestamp", "cryptocurrency", "tweet_id"]
        table = table.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table.write.mode(mode).partitionBy("dataset").parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """CSV folder with headers; fields keep their outer blanks and quotes are doubled."""
    _flat(df).write.mode(mode).options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_text(report: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Report lines (one string column) as text files."""
    report.select(F.col(report.columns[0]).cast("string").alias("value")).write.mode(mode).text(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when the folder holds a finished write."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force: bool = False) -> DataFrame:
    """Parquet table built on first use, or again when forced.

    Only a finished write counts, so a run that died half-way is built again.
    """
    if force or not table_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
