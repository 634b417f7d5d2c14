"""Profit and loss of decision logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.labels import direction
from tiltmeter.functions.ordering import BLOCK, running_sum

POSITION_SIZE = 1000.0


def step_pnl(action: Column, change_pct: Column, position: float = POSITION_SIZE) -> Column:
    return direction(action) * (change_pct / 100.0) * position


def with_pnl(log: DataFrame, action: str = "action_taken", change: str = "price_change_pct") -> DataFrame:
    return log.withColumn("pnl", step_pnl(F.col(action), F.col(change)))


def with_running_pnl(log: DataFrame, series: Sequence[str] = (), step: str = "step", block: int = BLOCK) -> DataFrame:
    """P&L per step and its running total in step order, per series."""
    return running_sum(with_pnl(log), step, F.col("pnl"), "cum_pnl", series, block)


def pnl_summary(log: DataFrame, *series: str) -> DataFrame:
    """Totals per series of a log that has `pnl`."""
    traded = F.col("action_taken") != "HOLD"
    trades = F.count_if(traded)
    wins = F.count_if(traded & (F.col("pnl") > 0))
    return log.groupBy(*series).agg(
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), trades.alias("trade_count"),
        wins.alias("win_count"), F.count_if(traded & (F.col("pnl") < 0)).alias("loss_count"),
        F.when(trades > 0, wins / trades).otherwise(F.lit(0.0)).alias("win_rate"),
    )


def pnl_compare(pairs: DataFrame) -> DataFrame:
    """`experiment`, `pnl_a`, `pnl_b` to the difference and which side did better."""
    delta = F.col("pnl_b") - F.col("pnl_a")
    return pairs.select(
        "experiment", "pnl_a", "pnl_b", delta.alias("delta"),
        F.when(delta > 0, "B better").when(delta < 0, "A better").otherwise("Tied").alias("tag"),
    )


def pair_totals(summary: DataFrame, series: str, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Totals of two series per experiment, for `pnl_compare`.

    `pairs` lists (experiment, series A, series B); the summary has one row per series.
    """
    wanted = F.array(*[
        F.struct(F.lit(name).alias("experiment"), (F.col(series) == a).alias("is_a"), (F.col(series) == b).alias("is_b"))
        for name, a, b in pairs
    ])
    rows = summary.select("total_pnl", F.explode(wanted).alias("_w"))
    return rows.groupBy(F.col("_w.experiment").alias("experiment")).agg(
        F.max(F.when(F.col("_w.is_a"), F.col("total_pnl"))).alias("pnl_a"),
        F.max(F.when(F.col("_w.is_b"), F.col("total_pnl"))).alias("pnl_b"),
    )
