"""Human-readable lines from one-row report tables, for text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fixed(pattern: str, value: Column, digits: int) -> Column:
    return F.format_string(pattern, F.bround(value, digits))


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _map_text(name: str) -> Column:
    """A map as `{a: 1, b: 2}`, largest first."""
    entries = F.array_sort(F.map_entries(name), lambda x, y: F.when(x["value"] > y["value"], -1).when(
        x["value"] < y["value"], 1).when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    return F.concat(
        F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string"))), ", "),
        F.lit("}"),
    )


def _listing(title: str, items: list[tuple[str, Column]]) -> Column:
    """A title and one aligned line per (name, text)."""
    width = max(len(name) for name, _ in items)
    return _lines(F.lit(title), *[F.concat(F.lit(f"  {name:<{width}}  "), text) for name, text in items])


def _number(name: str) -> Column:
    return F.col(name).cast("string")


def _part(count: str, rate: str) -> Column:
    return F.concat(_number(count), _fixed(" of all steps: %.2f %%", F.col(rate) * 100, 2))


def drift_text(report: DataFrame) -> DataFrame:
    """Summary lines of a `drift_steps` row."""
    return report.select(_listing("Drift of decisions", [
        ("steps", _number("total_steps")), ("changed", _part("mismatched_steps", "adr")),
        ("override broken", _part("oracle_violations", "oracle_violation_rate")),
    ]).alias("value"))


def override_drift_text(report: DataFrame, experiment: str) -> DataFrame:
    """Summary of a drift row with the overrides of both sides and the flips."""
    return report.select(_listing(f"Drift of decisions under {experiment}", [
        ("steps", _number("total_steps")), ("changed", _part("mismatched_steps", "adr")),
        ("overrides, before and after", F.concat_ws(", ", _number("oracle_baseline"), _number("oracle_mutant"))),
        ("changes", _map_text("action_flips")),
    ]).alias("value"))


def consensus_text(report: DataFrame, first: str = "Rule Engine", second: str = "Model") -> DataFrame:
    """Summary lines of a `consensus_steps` row."""
    return report.select(_listing(f"Agreement of {first} and {second}", [
        ("steps", _number("total_steps")), ("actions differ", _part("logic_gap_steps", "logic_gap_ratio")),
        ("policies differ", _part("policy_gap_steps", "policy_gap_ratio")),
        (f"{second} overridden", _part("oracle_overrides", "oracle_override_rate")),
        (f"actions of {first}", _map_text("rule_dist")), (f"actions of {second}", _map_text("agent_dist")),
        ("differences", _map_text("gap_transitions")),
    ]).alias("value"))


def pnl_line(summary: DataFrame, series: str) -> DataFrame:
    """One line per series of a P&L summary."""
    return summary.select(F.concat(
        F.format_string("  %-24s", F.col(series)), _fixed(" | P&L: %+9.2f USD", F.col("total_pnl"), 2),
        F.format_string(" | Trades: %4d", "trade_count"), _fixed(" | Win rate: %5.1f%%", F.col("win_rate") * 100, 1),
    ).alias("value"))


def pnl_table_text(comparison: DataFrame, first: str, second: str) -> DataFrame:
    """Aligned comparison table; the rows are one per experiment, so the text is small."""
    titles = ("experiment", first, second, "difference", "better")
    money = max(14, *[len(t) + 2 for t in titles[1:4]])
    heading = f"{titles[0]:<24}" + "".join(f"{t:>{money}}" for t in titles[1:4]) + f"  {titles[4]}"
    row = F.format_string(
        "%-24s" + f"%{money}.2f" * 3 + "  %s", "experiment", *[F.bround(c, 2) for c in ("pnl_a", "pnl_b", "delta")], "tag",
    )
    body = F.array_join(F.sort_array(F.collect_list(row)), "\n")
    return comparison.agg(F.concat_ws("\n", F.lit("P&L in USD"), F.lit(heading), body).alias("value"))
