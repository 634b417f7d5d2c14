"""Comparisons of decisions: against the baseline, between agents, and over the sweep.

A long table of decisions (`agent`, `dataset`, `window_id`, `cryptocurrency`, `action_taken`, ...) is compared
inside groups of rows for the same window. Such a group has at most one row per dataset and agent, so one
shuffle replaces a self-join and the decisions are computed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.config import ACTIONS, BASELINE, FAMILIES, MODEL_AGENT, RULE_AGENT, TargetRules
from tiltmeter.functions.labels import direction
from tiltmeter.functions.numeric import percent
from tiltmeter.functions.ordering import grouped_index

REGISTRY = ("dataset", "family", "strength", "label", "is_main")


def with_baseline(decisions: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Every decision next to the baseline decision of the same agent and window (null if there is none)."""
    same_window = Window.partitionBy("agent", "window_id", "cryptocurrency")
    return decisions.withColumn(
        "action_base", F.max(F.when(F.col("dataset") == baseline, F.col("action_taken"))).over(same_window),
    )


def matched(decisions: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Perturbed decisions that have a baseline twin, with a `flipped` flag."""
    return (
        with_baseline(decisions, baseline)
        .where((F.col("dataset") != baseline) & F.col("action_base").isNotNull())
        .withColumn("flipped", F.col("action_base") != F.col("action_taken"))
    )


def adr(decisions: DataFrame, baseline: str = BASELINE, *, count_unmatched: bool = False) -> DataFrame:
    """Action-difference ratio per (agent, dataset), over windows present on both sides.

    `count_unmatched` adds how many windows exist on one side only.
    """
    is_match = F.col("action_base").isNotNull()
    counted = with_baseline(decisions, baseline).groupBy("agent", "dataset").agg(
        F.count_if(is_match).alias("total"),
        F.count_if(F.col("action_base") != F.col("action_taken")).alias("changed"),
        F.count_if(~is_match).alias("unmatched_mut"),
    )
    per_agent = Window.partitionBy("agent")  # one row per dataset
    result = (
        counted.withColumn("_base", F.max(F.when(F.col("dataset") == baseline, F.col("total"))).over(per_agent))
        .withColumn("unmatched_base", F.coalesce(F.col("_base"), F.lit(0)) - F.col("total"))
        .where(F.col("dataset") != baseline)
        .withColumn("adr", F.when(F.col("total") > 0, F.col("changed") / F.col("total")).otherwise(F.lit(0.0)))
    )
    columns = ["agent", "dataset", "total", "changed", "adr"]
    return result.select(*columns, *(["unmatched_base", "unmatched_mut"] if count_unmatched else []))


def transitions(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Counts of `A>B` among rows whose two actions differ."""
    return (
        pairs.where(F.col(before) != F.col(after))
        .groupBy(*keys, F.concat_ws(">", before, after).alias("transition"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def transition_map(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transition counts as one map per key (six entries at most)."""
    entries = F.sort_array(F.collect_list(F.struct("transition", "count")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("transitions"))


def _counted() -> list[Column]:
    """Size of an action pair and the first window that shows it."""
    return [F.count(F.lit(1)).alias("_windows"), F.min("window_id").alias("_seen")]


def _top_changes(before: str, after: str, n: int = 3) -> Column:
    """Aggregate over counted action pairs: the n most frequent changes as `A>B:7 | B>C:2`.

    Equal counts stand in the order in which they first occur by window id.
    """
    entry = F.when(F.col(before) != F.col(after), F.struct(
        (-F.col("_windows")).alias("rank"), F.col("_seen").alias("seen"), F.concat_ws(">", before, after).alias("name"),
        F.col("_windows").alias("count"),
    ))
    ranked = F.slice(F.sort_array(F.collect_list(entry)), 1, n)
    return F.array_join(F.transform(ranked, lambda t: F.concat_ws(":", t["name"], t["count"].cast("string"))), " | ")


def top_flips(decisions: DataFrame) -> DataFrame:
    """Most frequent changes against the baseline per (agent, dataset)."""
    cells = matched(decisions).groupBy("agent", "dataset", "action_base", "action_taken").agg(*_counted())
    return cells.groupBy("agent", "dataset").agg(_top_changes("action_base", "action_taken").alias("top_flips"))


def _family_rank() -> Column:
    order = F.lit(len(FAMILIES))
    for i, family in enumerate((BASELINE, *FAMILIES)):
        order = F.when(F.col("family") == family, i - 1).otherwise(order)
    return order


def in_sweep_order(df: DataFrame, *then: str) -> DataFrame:
    return df.orderBy(_family_rank(), "strength", *then)


def sweep_adr(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """ADR of every dataset and agent with its registry entry and most frequent flips."""
    pairs = matched(decisions).groupBy("agent", "dataset", "action_base", "action_taken").agg(*_counted())
    # At most nine action pairs per (agent, dataset) are left, so the rest works on a handful of rows.
    flip = F.col("action_base") != F.col("action_taken")
    table = pairs.groupBy("agent", "dataset").agg(
        F.sum("_windows").alias("matched_win"),
        F.coalesce(F.sum(F.when(flip, F.col("_windows"))), F.lit(0)).alias("changed"),
        _top_changes("action_base", "action_taken").alias("top_flips"),
    )
    joined = table.join(F.broadcast(registry), "dataset").select(
        *REGISTRY, "agent", "matched_win", "changed",
        percent(F.col("changed"), F.col("matched_win")).alias("ADR_%"), "top_flips",
    )
    return in_sweep_order(joined, "agent")


def paired_agents(decisions: DataFrame, first: str = RULE_AGENT, second: str = MODEL_AGENT) -> DataFrame:
    """One row per (dataset, window) with both agents' decisions; windows one agent lacks are left out."""
    def of(agent: str, value: Column) -> Column:
        return F.max(F.when(F.col("agent") == agent, value))

    # Names, not codes: an agent may answer something other than the three actions.
    action, override = F.col("action_taken"), F.col("oracle_triggered")
    return decisions.where(F.col("agent").isin(first, second)).groupBy("dataset", "window_id", "cryptocurrency", "window_start").agg(
        of(first, action).alias("action_first"), of(second, action).alias("action_second"),
        of(first, override).alias("override_first"), of(second, override).alias("override_second"),
    ).where(F.col("action_first").isNotNull() & F.col("action_second").isNotNull())


def consensus(
    decisions: DataFrame, registry: DataFrame, first: str = RULE_AGENT, second: str = MODEL_AGENT,
) -> DataFrame:
    """Per dataset: how often two agents agree, their override counts and main disagreements."""
    cells = paired_agents(decisions, first, second).groupBy("dataset", "action_first", "action_second").agg(
        *_counted(), F.count_if("override_first").alias("_first"), F.count_if("override_second").alias("_second"),
    )
    differ = F.col("action_first") != F.col("action_second")
    table = cells.groupBy("dataset").agg(
        F.sum("_windows").alias("total_windows"),
        F.coalesce(F.sum(F.when(~differ, F.col("_windows"))), F.lit(0)).alias("agree_windows"),
        F.sum("_first").alias("oracle_det"), F.sum("_second").alias("oracle_model"),
        _top_changes("action_first", "action_second").alias("top_disagree"),
    )
    joined = table.join(F.broadcast(registry), "dataset").select(
        *REGISTRY, "total_windows", "agree_windows",
        percent(F.col("agree_windows"), F.col("total_windows")).alias("consensus_%"),
        "oracle_det", "oracle_model", "top_disagree",
    )
    return in_sweep_order(joined)


def main_only(table: DataFrame) -> DataFrame:
    """The datasets that stand for their family in short tables."""
    return table.where("is_main")


def agreement_matrix(decisions: DataFrame, first: str = RULE_AGENT, second: str = MODEL_AGENT) -> DataFrame:
    """Three rows per dataset, one column per action of the second agent, zero-filled; paired by window."""
    pairs = paired_agents(decisions, first, second)
    cells = pairs.groupBy("dataset").agg(*[
        F.count_if((F.col("action_first") == a) & (F.col("action_second") == b)).alias(f"{a}_{b}")
        for a in ACTIONS for b in ACTIONS
    ])
    rows = F.array(*[
        F.struct(F.lit(a).alias("rule_action"), *[F.col(f"{a}_{b}").alias(b) for b in ACTIONS]) for a in ACTIONS
    ])
    return cells.select("dataset", F.inline(rows))


def _action_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Zero-filled action counts per key in long form."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("action_taken") == a).alias(a) for a in ACTIONS],
    )
    cells = F.array(*[F.struct(F.lit(a).alias("action_taken"), F.col(a).alias("count")) for a in ACTIONS])
    return wide.select(*keys, "total", F.inline(cells))


def action_distribution(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Action counts and percents by family; the baseline appears in every family."""
    families = F.when(F.col("own") == BASELINE, F.array(*[F.lit(f) for f in FAMILIES])).otherwise(F.array("own"))
    named = F.broadcast(registry.select("dataset", F.col("family").alias("own"), "strength", "label"))
    return _action_counts(decisions, "dataset", "agent").join(named, "dataset").select(
        F.explode(families).alias("family"), "dataset", "label", "strength", "agent", "action_taken", "count",
        percent(F.col("count"), F.col("total")).alias("percent"),
    )


def variant_counts(decisions: DataFrame) -> DataFrame:
    """Action counts per (variant, dataset) in long form."""
    return _action_counts(decisions, "variant", "dataset").withColumn(
        "percent", percent(F.col("count"), F.col("total")),
    )


def variant_summary(decisions: DataFrame, notes: Mapping[str, str] | None = None) -> DataFrame:
    """Per policy variant: action counts over all datasets, windows and SELL rate."""
    table = decisions.groupBy("variant").agg(
        *[F.count_if(F.col("action_taken") == a).alias(a) for a in ACTIONS],
        F.count(F.lit(1)).alias("total_windows"),
    ).withColumn("sell_rate_%", percent(F.col("SELL"), F.col("total_windows")))
    if notes:
        pairs = [F.lit(part) for item in notes.items() for part in item]
        table = table.withColumn("design_goal", F.create_map(*pairs)[F.col("variant")])
    return table


def _of_family(decisions: DataFrame, registry: DataFrame, family: str) -> DataFrame:
    """Decisions of one family and of the baseline, cut before anything is shuffled."""
    wanted = registry.where(F.col("family").isin(family, BASELINE)).select("dataset")
    return decisions.join(F.broadcast(wanted), "dataset", "left_semi")


def flip_classes(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Every matched window of the injected datasets as flipped in a target, flipped elsewhere, or stable."""
    kind = (
        F.when(F.col("flipped") & (F.col("synthetic_count") > 0), "flipped_injected")
        .when(F.col("flipped"), "flipped_other").otherwise("stable")
    )
    return matched(_of_family(decisions, registry, "injection")).withColumn("flip_class", kind).select(
        "agent", "dataset", "window_id", "cryptocurrency", "action_base", "action_taken", "synthetic_count",
        "flip_class",
    )


def injection_flips(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Flip rates of injected datasets, in windows with synthetic posts and overall."""
    injected = registry.where(F.col("family") == "injection")
    targeted = F.col("synthetic_count") > 0
    counts = matched(_of_family(decisions, registry, "injection")).groupBy("agent", "dataset").agg(
        F.count(F.lit(1)).alias("matched_windows"), F.count_if(targeted).alias("targeted_windows"),
        F.count_if(targeted & F.col("flipped")).alias("flipped_targeted"), F.count_if("flipped").alias("flipped_all"),
    )
    return in_sweep_order(counts.join(F.broadcast(injected), "dataset").select(
        *REGISTRY, "matched_windows", "targeted_windows", "flipped_targeted",
        percent(F.col("flipped_targeted"), F.col("targeted_windows")).alias("targeted_flip_rate_%"),
        "flipped_all", percent(F.col("flipped_all"), F.col("matched_windows")).alias("all_flip_rate_%"), "agent",
    ), "agent")


def injection_ratio(windows: DataFrame, registry: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """Windows that received synthetic posts, with the ratio they really got."""
    injected = F.broadcast(registry.where(F.col("family") == "injection").select("dataset", "label", "strength"))
    return (
        windows.where(F.col("synthetic_count") > 0).join(injected, "dataset")
        .withColumn("original_tweet_count", F.col("tweet_count") - F.col("synthetic_count"))
        .select(
            "dataset", "label", F.col("strength").alias("nominal_injection_ratio"), "window_id", "cryptocurrency",
            "original_tweet_count", "synthetic_count",
            (F.col("synthetic_count") / F.col("original_tweet_count")).alias("actual_injection_ratio"),
            (F.col("synthetic_count") >= rules.max_synthetic).alias("cap_hit"),
        )
    )


def injection_ratio_summary(ratios: DataFrame) -> DataFrame:
    actual = F.col("actual_injection_ratio")
    return ratios.groupBy("dataset", "label", "nominal_injection_ratio").agg(
        F.count(F.lit(1)).alias("windows"), F.avg(actual).alias("mean_actual_ratio"),
        F.min(actual).alias("min_actual_ratio"), F.max(actual).alias("max_actual_ratio"),
        F.count_if("cap_hit").alias("cap_hit_windows"),
    ).withColumn("cap_hit_rate_%", percent(F.col("cap_hit_windows"), F.col("windows")))


def sensitivity(table: DataFrame, metric: str, *series: str) -> DataFrame:
    """A metric by strength within each family and series, with its change from the next weaker strength."""
    line = Window.partitionBy("family", *series).orderBy("strength")  # one row per strength
    return table.where(F.col("family") != BASELINE).select(
        "family", *series, "strength", F.col(f"`{metric}`").alias("value"),
        F.bround(F.col(f"`{metric}`") - F.lag(F.col(f"`{metric}`")).over(line), 2).alias("change"),
    )


def timeline(decisions: DataFrame, first: str = RULE_AGENT, second: str = MODEL_AGENT) -> DataFrame:
    """Both agents' actions as +1/0/-1 by position in time, per dataset and topic, with an agreement flag."""
    pairs = paired_agents(decisions, first, second).select(
        "dataset", "cryptocurrency", "window_id", "window_start",
        direction(F.col("action_first")).alias("first"), direction(F.col("action_second")).alias("second"),
        (F.col("action_first") == F.col("action_second")).cast("int").alias("agree"),
    )
    return grouped_index(pairs, ["dataset", "cryptocurrency"], ["window_start", "window_id"], "step")


def agreement_share(line: DataFrame) -> DataFrame:
    """Share of agreeing positions per dataset and topic of a timeline."""
    return line.groupBy("dataset", "cryptocurrency").agg(
        F.count(F.lit(1)).alias("steps"), percent(F.sum("agree"), F.count(F.lit(1)), 1).alias("agree_%"),
    )
