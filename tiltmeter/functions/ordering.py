"""Positions, running sums and row-based frames over an order that spans the whole table.

A window without a partition key pulls every row into one task, and a window per series still does so for a
series that holds a third of the table. Here rows get a dense position first; position blocks of fixed length
then serve as the partition key, so no task ever holds more than one block (plus a short halo).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.joins import join_null_safe

from tiltmeter.session import stage

BLOCK = 1 << 16
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows in range partitions with their partition and their number in it.

    Staged, so that the sampled range bounds are fixed for everything derived from them.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return stage(ranged, "positions").withColumns({
        "_part": F.shiftright("_seq", _ROW_BITS), "_seq": F.col("_seq").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    })


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "step") -> DataFrame:
    """Dense 0-based position in a total order; `order` must end in a unique key.

    One range shuffle, then a join with one offset per range partition. Placing the rows reads the input twice
    (the bounds are sampled), so costly columns are better added afterwards.
    """
    placed = _placed(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per range partition, a number the session fixes, so the broadcast cannot grow with the data.
    return (
        placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_seq"))
        .drop("_seq", "_part", "_offset")
    )


def grouped_index(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "step") -> DataFrame:
    """Dense 0-based position within each group, without gathering a group in one task.

    A large group spans many range partitions. Its rows are matched with their start by (group, partition), so
    no join key holds more rows than one range partition.
    """
    groups = list(groups)
    placed = _placed(df, [*groups, *order])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
        .select(*groups, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        join_null_safe(placed, cells, [*groups, "_part"])
        .withColumn(name, F.col("_offset") + F.col("_seq") - F.col("_first"))
        .drop("_seq", "_part", "_first", "_offset")
    )


def over_previous_rows(
    df: DataFrame, step: str, reach: int, columns: Callable[[Window], dict[str, Column]], block: int = BLOCK,
    reads: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns computed over frames that look back at most `reach` rows.

    The last `reach` rows of every block are copied into the next one as a halo, so each block is complete on
    its own; the copies are dropped at the end. `columns` receives the window spec, ordered by `step`.
    Steps must be 0, 1, 2, ...; a gap, a repeated or a null step is an error, since frames would miss rows.
    With `reads`, frames run over the step and these columns alone, and their results meet the wide rows by step:
    `df` is then read twice, but no other column travels through the blocks.
    """
    if not 0 < reach <= block:
        raise ValueError(f"reach must be between 1 and {block}")
    if reads is not None:
        known = F.coalesce(F.col(step), F.raise_error(F.lit("a step is null")).cast("bigint"))
        framed = over_previous_rows(df.select(known.alias(step), *reads), step, reach, columns, block)
        added = list(columns(Window.partitionBy(F.lit(0)).orderBy(step)))
        kept = [c for c in df.columns if c not in added]
        joined = df.select(*kept).join(framed.select(step, *added), step)
        return joined.select(*df.columns, *[c for c in added if c not in df.columns])
    home = F.floor(F.col(step) / block).cast("bigint")
    near_end = F.pmod(F.col(step), F.lit(block)) >= block - reach
    spread = df.withColumn("_block", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
    spec = Window.partitionBy("_block").orderBy(step)
    dense = (F.col(step) == 0) & F.col("_before").isNull() | (F.col("_before") == F.col(step) - 1)
    gap = F.raise_error(F.format_string("steps are not dense at %s", F.col(step).cast("string"))).cast("boolean")
    kept = F.when(F.col("_block").eqNullSafe(home), F.when(dense, True).otherwise(gap)).otherwise(False)
    framed = spread.withColumns({**columns(spec), "_before": F.lag(step).over(spec)})
    return framed.where(kept).drop("_block", "_before")


def running_sum(
    df: DataFrame, step: str, value: Column, name: str, series: Sequence[str] = (), block: int = BLOCK,
) -> DataFrame:
    """Cumulative sum of `value` by `step`, per series.

    Block totals are prefix-summed inside groups of `block` blocks, and those groups once more, so the last
    level holds rows / block^2 entries; every level is computed in tasks of bounded size.
    """
    series = list(series)
    base = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(step) / block).cast("bigint"))
    upper = F.floor(F.col("_block") / block).cast("bigint")

    totals = base.groupBy(*series, "_block").agg(F.sum("_value").alias("_total")).withColumn("_group", upper)
    group_totals = totals.groupBy(*series, "_group").agg(F.sum("_total").alias("_group_total"))

    def before(*keys: str, order: str) -> Window:
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    group_starts = group_totals.select(
        *series, "_group",
        F.coalesce(F.sum("_group_total").over(before(*series, order="_group")), F.lit(0.0)).alias("_group_start"),
    )
    starts = join_null_safe(totals, group_starts, [*series, "_group"]).select(
        *series, "_block",
        (F.col("_group_start")
         + F.coalesce(F.sum("_total").over(before(*series, "_group", order="_block")), F.lit(0.0))).alias("_start"),
    )
    so_far = Window.partitionBy(*series, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_null_safe(base, starts, [*series, "_block"])
        .withColumn(name, F.col("_start") + F.sum("_value").over(so_far))
        .drop("_value", "_block", "_start")
    )
