"""End-to-end runs: from posts or market steps to saved tables and reports.

Each run writes every table once and builds later ones from what it wrote, so a run that stops can be
continued from its folders. Tables staged on the way are removed at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tiltmeter.config import BASELINE, Experiment, StepPolicy, WindowPolicy
from tiltmeter.operators import compare, decisions, perturb, pnl, reports, scoring, steps, windows
from tiltmeter.operators.cleaning import clean_posts
from tiltmeter.plans.sweep import default_scorer, run_sweep, run_sweep_rows
from tiltmeter.session import stage, staging_scope
from tiltmeter.sources import sinks
from tiltmeter.sources.posts import normalize_scored
from tiltmeter.sources.registry import dataset_registry, observed_violations, plan_metrics, window_metrics
from tiltmeter.sources.score_store import ScoreStore

Scorer = Callable[[Column], Column]


def _tidy(run: Callable[..., object]) -> Callable[..., object]:
    """Run inside a staging scope; what a run returns must not depend on staged tables."""
    @wraps(run)
    def scoped(first: DataFrame, *args: object, **kwargs: object) -> object:
        with staging_scope(first.sparkSession):
            return run(first, *args, **kwargs)

    return scoped


@_tidy
def score_baseline(
    raw: DataFrame, path: str, probabilities: Scorer | None = None, experiment: Experiment = Experiment(), *,
    force: bool = False, store: str | None = None, **cleaning: object,
) -> DataFrame:
    """Clean and score raw posts once; later calls read the table.

    With `store`, scores of texts are kept there and shared by all runs with this scorer: a run scores new texts only.
    The word-list scorer is cheaper than any lookup, so without a store it scores every row where it is.
    """
    def build() -> DataFrame:
        clean = clean_posts(raw, sort=False, **cleaning)
        if store is not None:
            scored = scoring.score_new(clean, probabilities or default_scorer(experiment), ScoreStore(raw.sparkSession, store)).drop("score_batch")
        elif probabilities is None:
            scored = scoring.add_scores(clean, default_scorer(experiment))
        else:
            scored, _ = scoring.score_distinct(clean, probabilities)
        return normalize_scored(scored)

    return sinks.cached_table(raw.sparkSession, path, build, force=force)


@_tidy
def sweep_run(
    scored: DataFrame, out: str, experiment: Experiment = Experiment(), probabilities: Scorer | None = None,
    model: Callable[[], decisions.Answer] | Column | None = None, *, save_posts: bool = False,
    variants: Mapping[str, WindowPolicy] | None = None,
) -> dict[str, str]:
    """Sweep, decisions of the rule agent (and a model), and all comparison tables; returns the folders.

    Row counts and directions of the datasets are observed while the tables are written; a broken rule is an error.
    """
    spark: SparkSession = scored.sparkSession
    registry = dataset_registry(spark, experiment.sweep)
    paths: dict[str, str] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
        return spark.read.schema(df.schema).parquet(paths[name])

    def report(name: str, df: DataFrame) -> None:
        paths[name] = f"{out}/{name}"
        sinks.write_csv(df, paths[name])

    tables = run_sweep(scored, experiment, probabilities)
    seen, planned = Observation("windows"), Observation("plan")
    frame = keep("windows", tables.windows.observe(seen, *window_metrics(experiment.sweep)))
    report("targets", tables.plan.observe(planned, *plan_metrics(experiment.sweep)))
    broken = observed_violations(experiment.sweep, seen.get, planned.get)
    if broken:
        raise ValueError(f"the sweep broke its rules: {broken}")
    if save_posts:
        paths["datasets"] = f"{out}/datasets"
        sinks.save_datasets(run_sweep_rows(scored, experiment, probabilities), paths["datasets"])

    report("busiest_windows", windows.busiest_windows(frame.where(F.col("dataset") == BASELINE)))
    report("regime_counts", windows.regime_counts(frame.where(F.col("dataset") == BASELINE)))
    report("load_summary", windows.load_summary(frame))
    report("negative_summary", windows.negative_summary(frame))
    report("negative_thresholds", windows.negative_thresholds(frame))
    report("most_negative", windows.most_negative(frame))
    ratios = compare.injection_ratio(frame, registry, experiment.targets)
    report("injection_actual_ratio_table", ratios)
    report("injection_actual_ratio_summary", compare.injection_ratio_summary(ratios))

    logs = keep("trajectories", decisions.rule_agent(frame, experiment.policy) if model is None
                else decisions.rule_and_model(frame, model, experiment.policy))
    adr = compare.sweep_adr(logs, registry)
    report("sweep_adr_table", adr)
    report("adr_table", compare.main_only(adr))
    report("flip_classes", compare.flip_classes(logs, registry))
    if variants:
        report("variant_counts", compare.variant_counts(decisions.policy_variants(frame, variants)))
        report("variant_summary", compare.variant_summary(decisions.policy_variants(frame, variants)))
    report("injection_flip_table", compare.injection_flips(logs, registry))
    report("family_action_distribution", compare.action_distribution(logs, registry))
    report("adr_sensitivity", compare.sensitivity(adr, "ADR_%", "agent"))
    if model is not None:
        agreement = compare.consensus(logs, registry)
        report("sweep_consensus_table", agreement)
        report("consensus_table", compare.main_only(agreement))
        report("timeline", compare.timeline(logs))
        report("agreement_matrix", compare.agreement_matrix(logs))
        report("consensus_sensitivity", compare.sensitivity(agreement, "consensus_%"))
    return paths


@_tidy
def drift_run(
    market: DataFrame, out: str, factor: float = 2.0, lag: int = 3, policy: StepPolicy = StepPolicy(),
    lag_sentiment: bool = False,
) -> dict[str, str]:
    """Rule agent on market steps and on its mutants: logs, drift reports and the P&L comparison.

    `market` needs a dense `step`, as `load_steps` gives it. The lag delays the news, which the rule agent does not read;
    `lag_sentiment` adds a mutant that delays the sentiment it decides on.
    """
    inputs = {
        BASELINE: market,
        f"intensity_k{factor:g}": perturb.amplify_steps(market, factor),
        f"temporal_jitter_n{lag}": perturb.row_lag(market, lag),
    }
    if lag_sentiment:
        inputs[f"sentiment_lag_n{lag}"] = perturb.row_lag(market, lag, numeric="social_sentiment_score")
    logs = {name: pnl.with_running_pnl(stage(decisions.step_rule_agent(df, policy), "log")) for name, df in inputs.items()}
    return _compare_logs(logs, out, "Baseline", "Mutant")


def _compare_logs(logs: Mapping[str, DataFrame], out: str, first: str, second: str) -> dict[str, str]:
    paths, saved = {}, {}
    for name, log in logs.items():
        paths[f"traj_{name}"] = f"{out}/traj_{name}"
        saved[name] = stage(log, "log")
        sinks.write_json(saved[name], paths[f"traj_{name}"])
    totals, drift = _against_baseline(saved)
    for name in list(saved)[1:]:
        paths[f"drift_report_{name}"] = f"{out}/drift_report_{name}"
        sinks.write_text(reports.drift_text(drift.where(F.col("experiment") == name)), paths[f"drift_report_{name}"])
    pairs = [(name, BASELINE, name) for name in saved if name != BASELINE]
    table = pnl.pnl_compare(pnl.pair_totals(totals, "experiment", pairs))
    paths["drift_pnl_comparison"] = f"{out}/drift_pnl_comparison"
    sinks.write_text(
        reports.pnl_table_text(table, first, second).unionByName(reports.pnl_line(totals, "experiment")),
        paths["drift_pnl_comparison"],
    )
    return paths


def _against_baseline(logs: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """P&L totals of every log, and the drift of every other log from the baseline: a few rows each, kept.

    One shuffle by step serves all experiments, whatever their number.
    """
    stacked = None
    for name, log in logs.items():
        one = log.select(F.lit(name).alias("experiment"), "step", "action_taken", "oracle_triggered", "pnl")
        stacked = one if stacked is None else stacked.unionByName(one)
    totals = stage(pnl.pnl_summary(stacked, "experiment"), "totals")
    return totals, stage(steps.drift_all(stacked, BASELINE, [name for name in logs if name != BASELINE]), "drift")


@_tidy
def hybrid_run(
    market: DataFrame, out: str, factor: float = 2.0, sample: int | None = None, probabilities: Scorer | None = None,
) -> dict[str, str]:
    """Rule agent against the composite agent (or a text scorer) on amplified steps.

    Every step is decided once; P&L and reports read the staged logs. `sample` takes the first steps.
    """
    louder = perturb.amplify_steps(market, factor)
    if sample is not None:
        louder = louder.where(F.col("step") < sample)
    rule = stage(pnl.with_pnl(decisions.step_rule_agent(louder)), "log")
    other = decisions.composite_agent(louder) if probabilities is None else decisions.model_step_agent(louder, probabilities)
    agent = stage(pnl.with_pnl(other), "log")
    paths = {name: f"{out}/{name}" for name in ("traj_rule", "traj_agent", "consensus_report", "hybrid_pnl", "combined_log")}
    sinks.write_json(pnl.with_running_pnl(rule), paths["traj_rule"])
    sinks.write_json(pnl.with_running_pnl(agent), paths["traj_agent"])
    sinks.write_text(reports.consensus_text(steps.consensus_steps(rule, agent)), paths["consensus_report"])
    both = pnl.pnl_summary(
        rule.select("action_taken", "pnl", F.lit("rule").alias("series"))
        .unionByName(agent.select("action_taken", "pnl", F.lit("agent").alias("series"))), "series",
    )
    table = pnl.pnl_compare(pnl.pair_totals(both, "series", [(f"k{factor:g}", "rule", "agent")]))
    sinks.write_text(reports.pnl_table_text(table, "Rule Engine", "Agent"), paths["hybrid_pnl"])
    sinks.write_json(steps.combined_log(rule, agent), paths["combined_log"])
    return paths


@_tidy
def post_level_run(
    labelled: DataFrame, out: str, decide: Callable[[Column, Column, Column], Column], factor: float = 2.0, lag: int = 3,
) -> dict[str, str]:
    """Post-level agent with a bucketed decision cache on a market frame and its two mutants.

    `labelled` needs `step`, `tweet_text`, `label`, `timestamp` and `cryptocurrency`.
    """
    base = stage(perturb.market_frame(labelled), "frame")
    inputs: Sequence[tuple[str, DataFrame]] = (
        (BASELINE, base), (f"intensity_k{factor:g}", perturb.emphasize(base, factor)),
        (f"temporal_jitter_n{lag}", perturb.row_lag(base, lag, text="tweet_text")),
    )
    paths, saved = {}, {}
    for name, df in inputs:
        paths[f"traj_{name}"] = f"{out}/traj_{name}"
        saved[name] = stage(pnl.with_pnl(decisions.decide_bucketed(df, decide), change="price_change_24h_percent"), "log")
        sinks.write_json(saved[name], paths[f"traj_{name}"])
    totals, drift = _against_baseline(saved)
    text = None
    for name in list(saved)[1:]:
        part = reports.override_drift_text(drift.where(F.col("experiment") == name), name)
        text = part if text is None else text.unionByName(part)
    paths["drift_report"] = f"{out}/drift_report"
    sinks.write_text(text.unionByName(reports.pnl_line(totals, "experiment")), paths["drift_report"])
    return paths
