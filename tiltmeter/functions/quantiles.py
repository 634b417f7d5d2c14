"""Exact interpolated percentiles whose memory does not grow with the group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.joins import join_null_safe

ACCURACY = 10_000


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, outputs: Mapping[str, float], accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with the linearly interpolated percentiles of `value` named in `outputs`.

    Null keys are a group of their own, null and NaN values count nothing, a group without values has null percentiles.
    """
    return percentiles_of(df, keys, {name: (value, p) for name, p in outputs.items()}, accuracy=accuracy)


def percentiles_of(
    df: DataFrame, keys: Sequence[str], outputs: Mapping[str, tuple[str, float]], others: Mapping[str, Column] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with the interpolated percentiles in `outputs` (name: column and share) and the aggregates `others`.

    The built-in `percentile` keeps every distinct value of a group in one buffer. Here one aggregate over all
    columns holds `others` and bounded sketches that bracket each wanted rank. A second pass collapses the rows under a
    bracket and those above it to one row each (their count and the value next to the bracket), and only the bracket is
    ordered. All groups go this way, whatever their size. A rank that falls outside its bracket is an error.
    `df` is read twice, whatever the number of columns and percentiles.
    """
    keys, others = list(keys), dict(others or {})
    columns = list(dict.fromkeys(column for column, _ in outputs.values()))
    margin = 4.0 / accuracy

    def usable(column: str) -> Column:
        return F.when(~F.isnan(column), F.col(column))

    def edges(column: str) -> list[float]:
        return [e for c, p in outputs.values() if c == column for e in (max(0.0, p - margin), min(1.0, p + margin))]

    sketch = df.groupBy(*keys).agg(
        *[aggregate.alias(name) for name, aggregate in others.items()],
        *[F.count(usable(c)).alias(f"_n_{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(usable(c), edges(c), accuracy).alias(f"_edges_{i}") for i, c in enumerate(columns)],
    )
    wanted, used = [], dict.fromkeys(columns, 0)
    for name, (column, p) in outputs.items():
        i, at = columns.index(column), used[column]
        used[column] += 2
        wanted.append(F.struct(
            F.lit(name).alias("name"), F.lit(i).alias("column"), (F.lit(float(p)) * (F.col(f"_n_{i}") - 1)).alias("rank"),
            F.get(f"_edges_{i}", F.lit(at)).alias("low"), F.get(f"_edges_{i}", F.lit(at + 1)).alias("high"),
        ))
    brackets = sketch.select(*keys, F.struct(F.lit(0).alias("_"), *others).alias("_others"), F.array(*wanted).alias("_wanted"))
    rows = df.select(*keys, F.array(*[usable(c).cast("double") for c in columns]).alias("_values"))
    entries = join_null_safe(rows, brackets, keys).select(*keys, "_others", "_values", F.explode("_wanted").alias("_w")).select(
        *keys, "_others", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"), F.col("_w.low").alias("_low"),
        F.col("_w.high").alias("_high"), F.get("_values", F.col("_w.column")).alias("_v"),
    )
    zone = F.when(F.col("_v").isNull(), -2).when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    # Equal values collapse before anything is ordered, and so does all that lies outside the bracket. Rows without a
    # value keep their group, but count nothing.
    counted = (
        entries.withColumn("_zone", zone)
        .groupBy(*keys, "_name", "_zone", F.when(F.col("_zone") == 0, F.col("_v")).alias("_at"))
        .agg(F.count("_v").alias("_c"), F.first("_rank").alias("_rank"), F.min("_v").alias("_least"),
             F.max("_v").alias("_most"), F.first("_others").alias("_others"))
    )
    upto = Window.partitionBy(*keys, "_name").orderBy("_zone", "_at").rowsBetween(Window.unboundedPreceding, 0)
    at = counted.withColumn("_end", F.sum("_c").over(upto))
    outside = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")

    def value_at(rank: Column) -> Column:
        here = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
        known = (
            F.when((F.col("_zone") == -1) & (rank == F.col("_end") - 1), F.col("_most"))
            .when((F.col("_zone") == 1) & (rank == F.col("_end") - F.col("_c")), F.col("_least"))
            .when(F.col("_zone") == 0, F.col("_at")).otherwise(outside)
        )
        return F.max(F.when(here, known))

    picked = at.groupBy(*keys, "_name").agg(
        F.first("_rank").alias("_rank"), value_at(F.floor("_rank")).alias("_a"), value_at(F.ceil("_rank")).alias("_b"),
        F.first("_others").alias("_others"),
    )
    exact = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    found = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, exact)).alias(name) for name in outputs], F.first("_others").alias("_others"),
    )
    return found.select(*keys, *outputs, *[F.col(f"_others.{name}").alias(name) for name in others])
