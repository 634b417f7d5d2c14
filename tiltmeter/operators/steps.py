"""Comparisons of step logs: drift, consensus, side-by-side views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.config import ACTIONS


def pair_steps(left: DataFrame, right: DataFrame, step: str = "step") -> DataFrame:
    """Rows of two logs side by side (`a_...`, `b_...`), matched on the step.

    A full outer join, so that a step missing on one side shows up instead of vanishing.
    """
    a = left.select(F.col(step), *[F.col(c).alias(f"a_{c}") for c in left.columns if c != step], F.lit(1).alias("_a"))
    b = right.select(F.col(step), *[F.col(c).alias(f"b_{c}") for c in right.columns if c != step], F.lit(1).alias("_b"))
    return a.join(b, step, "full_outer")


def _checked(df: DataFrame) -> DataFrame:
    """Fail when the two logs did not have the same steps."""
    a, b = F.col("_steps_a"), F.col("_steps_b")
    message = F.format_string("step logs differ in length: %d vs %d", a, b)
    ok = (a == F.col("total_steps")) & (b == F.col("total_steps"))
    return df.withColumn(
        "total_steps", F.when(ok, F.col("total_steps")).otherwise(F.raise_error(message).cast("bigint")),
    ).drop("_steps_a", "_steps_b")


def _lengths() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_steps"), F.count("_a").alias("_steps_a"), F.count("_b").alias("_steps_b")]


def _rate(part: str) -> Column:
    return F.when(F.col("total_steps") > 0, F.col(part) / F.col("total_steps")).otherwise(F.lit(0.0))


def _pair_counts(before: str, after: str, sep: str) -> tuple[list[Column], Column]:
    """One counter per action pair, and the map of the changes that occur, built from those counters."""
    pairs = [(a, b) for a in ACTIONS for b in ACTIONS if a != b]
    counters = [
        F.count_if((F.col(before) == a) & (F.col(after) == b)).alias(f"_{a}_{b}") for a, b in pairs
    ]
    entries = F.array(*[
        F.struct(F.lit(f"{a}{sep}{b}").alias("key"), F.col(f"_{a}_{b}").alias("value")) for a, b in pairs
    ])
    return counters, F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def _distribution(column: str, prefix: str) -> tuple[list[Column], Column]:
    counters = [F.count_if(F.col(column) == a).alias(f"_{prefix}_{a}") for a in ACTIONS]
    entries = F.array(*[
        F.struct(F.lit(a).alias("key"), F.col(f"_{prefix}_{a}").alias("value")) for a in ACTIONS
    ])
    return counters, F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def drift_steps(base: DataFrame, mutant: DataFrame) -> DataFrame:
    """One row: changed steps, override violations, overrides on both sides and the flips."""
    counters, flips = _pair_counts("a_action_taken", "b_action_taken", " -> ")
    one = pair_steps(base, mutant).agg(
        *_lengths(),
        F.count_if(F.col("a_action_taken") != F.col("b_action_taken")).alias("mismatched_steps"),
        F.count_if(F.col("a_oracle_triggered") & (F.col("b_action_taken") != "HOLD")).alias("oracle_violations"),
        F.count_if("a_oracle_triggered").alias("oracle_baseline"),
        F.count_if("b_oracle_triggered").alias("oracle_mutant"),
        *counters,
    )
    return _checked(one).select(
        "total_steps", "mismatched_steps", _rate("mismatched_steps").alias("adr"), "oracle_violations",
        _rate("oracle_violations").alias("oracle_violation_rate"), "oracle_baseline", "oracle_mutant",
        flips.alias("action_flips"),
    )


def drift_all(logs: DataFrame, baseline: str, experiments: Sequence[str], name: str = "experiment", step: str = "step") -> DataFrame:
    """`drift_steps` of many experiments against the baseline, one row each, from one stacked log (`name`, `step`, ...).

    Every step becomes one row with a slot per experiment: one scan and one shuffle by step, whatever the number of
    experiments, and only counters after that. Actions are held as numbers, so the slots are plain hash aggregates.
    """
    known = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action_taken"))
    code = F.when(known > 0, known).otherwise(F.xxhash64("action_taken"))  # other actions count as changes, not as flips
    slots: list[Column] = []
    for i, experiment in enumerate([baseline, *experiments]):
        mine = F.col(name) == experiment
        slots += [
            F.max(F.when(mine & F.col("action_taken").isNotNull(), code)).alias(f"_a{i}"),
            F.max(F.when(mine, F.col("oracle_triggered").cast("int"))).alias(f"_o{i}"), F.count_if(mine).alias(f"_n{i}"),
        ]
    rows = logs.where(F.col(name).isin([baseline, *experiments])).groupBy(step).agg(*slots)
    pairs = F.array(*[
        F.struct(F.lit(e).alias(name), *[F.col(f"_{c}{j}").alias(f"{side}{c}") for c in "aon" for side, j in (("a_", 0), ("b_", i))])
        for i, e in enumerate(experiments, 1)
    ])
    counters = [
        F.count_if((F.col("a_a") == ACTIONS.index(a) + 1) & (F.col("b_a") == ACTIONS.index(b) + 1)).alias(f"_{a}_{b}")
        for a in ACTIONS for b in ACTIONS if a != b
    ]
    _, flips = _pair_counts("a_a", "b_a", " -> ")
    one = rows.select(F.inline(pairs)).where("a_n > 0 or b_n > 0").groupBy(name).agg(
        F.count(F.lit(1)).alias("total_steps"), F.sum("a_n").alias("_steps_a"), F.sum("b_n").alias("_steps_b"),
        F.count_if(F.col("a_a") != F.col("b_a")).alias("mismatched_steps"),
        F.count_if((F.col("a_o") == 1) & (F.col("b_a") != ACTIONS.index("HOLD") + 1)).alias("oracle_violations"),
        F.count_if(F.col("a_o") == 1).alias("oracle_baseline"), F.count_if(F.col("b_o") == 1).alias("oracle_mutant"), *counters,
    )
    return _checked(one).select(
        name, "total_steps", "mismatched_steps", _rate("mismatched_steps").alias("adr"), "oracle_violations",
        _rate("oracle_violations").alias("oracle_violation_rate"), "oracle_baseline", "oracle_mutant", flips.alias("action_flips"),
    )


def consensus_steps(rule: DataFrame, agent: DataFrame) -> DataFrame:
    """One row: gaps after and before the override, overrides of the second agent, distributions, transitions."""
    counters, gaps = _pair_counts("a_action_taken", "b_action_taken", " -> ")
    rule_counts, rule_map = _distribution("a_action_taken", "rule")
    agent_counts, agent_map = _distribution("b_action_taken", "agent")
    one = pair_steps(rule, agent).agg(
        *_lengths(),
        F.count_if(F.col("a_action_taken") != F.col("b_action_taken")).alias("logic_gap_steps"),
        F.count_if(F.col("a_policy_action") != F.col("b_policy_action")).alias("policy_gap_steps"),
        F.count_if(F.col("b_policy_action").isin("BUY", "SELL") & F.col("b_oracle_triggered")).alias("oracle_overrides"),
        *counters, *rule_counts, *agent_counts,
    )
    return _checked(one).select(
        "total_steps", "logic_gap_steps", _rate("logic_gap_steps").alias("logic_gap_ratio"),
        "policy_gap_steps", _rate("policy_gap_steps").alias("policy_gap_ratio"),
        "oracle_overrides", _rate("oracle_overrides").alias("oracle_override_rate"),
        rule_map.alias("rule_dist"), agent_map.alias("agent_dist"), gaps.alias("gap_transitions"),
    )


def compare_steps(logs: DataFrame, steps: Sequence[int], experiments: Sequence[str], column: str = "action_taken") -> DataFrame:
    """Chosen steps across experiments, one column per experiment; the step filter reaches the scan."""
    return (
        logs.where(F.col("step").isin(list(steps)))
        .groupBy("step").pivot("experiment", list(experiments)).agg(F.first(column))
    )


def show_decisions(log: DataFrame, n: int = 10, action: str | None = None) -> DataFrame:
    """First n decisions in step order, of one action if given; each task keeps its own n best rows."""
    rows = log if action is None else log.where(F.col("action_taken") == action)
    return rows.orderBy("step").limit(n)


def first_active(log: DataFrame, n: int = 3) -> DataFrame:
    """First n steps on which the agent itself chose to act."""
    return log.where(F.col("policy_action") != "HOLD").orderBy("step").limit(n)


def combined_log(rule: DataFrame, agent: DataFrame) -> DataFrame:
    """Both logs by step with prefixed columns, both P&Ls and an agreement flag. A step that one log lacks is an error."""
    a = rule.select("step", *[F.col(c).alias(f"rule_{c}") for c in rule.columns if c not in ("step", "pnl")],
                    F.col("pnl").alias("pnl_rule"))
    b = agent.select("step", *[F.col(c).alias(f"agent_{c}") for c in agent.columns if c not in ("step", "pnl")],
                     F.col("pnl").alias("pnl_agent"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "step", "full_outer")
    lacking = F.raise_error(F.format_string("only one of the logs has step %s", F.col("step").cast("string"))).cast("boolean")
    agree = F.col("rule_action_taken") == F.col("agent_action_taken")
    return both.withColumn("actions_agree", F.when(F.col("_a").isNull() | F.col("_b").isNull(), lacking).otherwise(agree)).drop("_a", "_b")
