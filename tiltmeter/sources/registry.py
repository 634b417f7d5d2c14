"""The datasets of a sweep as a small dimension table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltmeter.config import BASELINE, Sweep

DIRECTIONS = ("positive_injection", "negative_injection")


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dataset_registry(spark: SparkSession, sweep: Sweep = Sweep()) -> DataFrame:
    """One literal row per dataset; its size is fixed by the configuration, so it may be broadcast."""
    rows = ", ".join(
        f"({_quote(v.dataset)}, {_quote(v.family)}, {v.strength}D, {_quote(v.label)}, {str(v.is_main).lower()})"
        for v in sweep.variants()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(dataset, family, strength, label, is_main)")


def main_views(long_table: DataFrame, registry: DataFrame, prefix: str = "main") -> list[str]:
    """Temp views `<prefix>_<family>` over the dataset that stands for each family."""
    names = []
    for family in ("baseline", "sentiment", "jitter", "injection"):
        keep = F.broadcast(registry.where(F.col("is_main") & (F.col("family") == family)).select("dataset"))
        name = f"{prefix}_{family}"
        long_table.join(keep, "dataset", "left_semi").createOrReplaceTempView(name)
        names.append(name)
    return names


def dataset_qa(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Row and synthetic-row counts per dataset with its registry entry."""
    counts = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col("is_synthetic"), F.lit(False))).alias("synthetic_rows"),
        F.count_if(F.col("adversarial_direction") == "positive_injection").alias("positive_rows"),
        F.count_if(F.col("adversarial_direction") == "negative_injection").alias("negative_rows"),
    )
    named = counts.join(F.broadcast(registry), "dataset", "left")
    return named.select(
        "dataset", F.coalesce("family", F.lit("alias")).alias("family"), "strength",
        F.coalesce("label", "dataset").alias("label"), F.coalesce("is_main", F.lit(False)).alias("is_main"),
        "rows", "synthetic_rows", "positive_rows", "negative_rows",
    ).orderBy("family", "strength", "dataset")


def qa_violations(qa: DataFrame) -> DataFrame:
    """Datasets that break a rule of the sweep; empty when all is well.

    Amplified and jittered datasets keep the baseline's row count; injected ones hold both directions.
    """
    whole = Window.partitionBy()  # one row per dataset
    base = F.max(F.when(F.col("family") == "baseline", F.col("rows"))).over(whole)
    reason = (
        F.when(F.col("family").isin("sentiment", "jitter") & (F.col("rows") != F.col("_base")), "row count changed")
        .when((F.col("family") == "injection") & (F.col("rows") - F.col("synthetic_rows") != F.col("_base")), "row count changed")
        .when((F.col("family") == "injection") & (F.least("positive_rows", "negative_rows") == 0), "one direction only")
    )
    return qa.withColumn("_base", base).withColumn("reason", reason).where(F.col("reason").isNotNull()).select("dataset", "reason")


def window_metrics(sweep: Sweep = Sweep()) -> list[Column]:
    """Post counts of every dataset, as metrics to observe while the sweep's windows are written."""
    names = [v.dataset for v in sweep.variants()]
    return [F.sum(F.when(F.col("dataset") == d, F.col(c))).alias(f"{d}|{c}") for d in names for c in ("tweet_count", "synthetic_count")]


def plan_metrics(sweep: Sweep = Sweep()) -> list[Column]:
    """Synthetic posts by direction of every injected dataset, as metrics to observe while the plan is written."""
    return [
        F.sum(F.when((F.col("dataset") == v.dataset) & (F.col("adversarial_direction") == d), F.col("synthetic_count"))).alias(f"{v.dataset}|{d}")
        for v in sweep.variants() if v.family == "injection" for d in DIRECTIONS
    ]


def observed_violations(sweep: Sweep, windows: Mapping[str, int | None], plan: Mapping[str, int | None]) -> list[tuple[str, str]]:
    """(dataset, reason) for every rule of `qa_violations` that the observed metrics break; needs no further scan."""
    def posts(dataset: str) -> int:
        return windows[f"{dataset}|tweet_count"] or 0

    broken = []
    for v in sweep.variants():
        if v.family in ("sentiment", "jitter") and posts(v.dataset) != posts(BASELINE):
            broken.append((v.dataset, "row count changed"))
        if v.family == "injection":
            if posts(v.dataset) - (windows[f"{v.dataset}|synthetic_count"] or 0) != posts(BASELINE) - (windows[f"{BASELINE}|synthetic_count"] or 0):
                broken.append((v.dataset, "row count changed"))
            if not all(plan[f"{v.dataset}|{d}"] for d in DIRECTIONS):
                broken.append((v.dataset, "one direction only"))
    return broken
