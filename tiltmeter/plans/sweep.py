"""The whole sweep at window level from one pass over the posts.

Amplified datasets share the baseline's windows, so all factors are aggregates of the same groups. Injected
datasets are baseline windows plus a few synthetic posts, so they are merged from finished windows. Only the
jittered datasets need rows of their own: the pass expands a post to 1 + (number of jitters) rows, inside the
task that combines them, instead of one per dataset.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.config import BASELINE, LABELS, Experiment, require_columns
from tiltmeter.functions.numeric import clean_double, keyed_draw
from tiltmeter.operators.injection import inject_posts, injection_plan, select_targets
from tiltmeter.operators.perturb import sweep_rows
from tiltmeter.operators.scoring import add_scores, lexicon_probabilities
from tiltmeter.operators.windows import COUNTS, WINDOW_COLUMNS, describe_windows, exprs, window_features
from tiltmeter.session import stage

_COUNTS = ("tweet_count", "synthetic_count", *[f"{name}_count" for name in LABELS])
_WEIGHTS = ("_scored", "_confident")


@dataclass(frozen=True)
class SweepTables:
    """What a sweep run leaves behind."""

    windows: DataFrame    # every dataset, one row per (dataset, topic, window)
    targets: DataFrame    # chosen windows with direction
    plan: DataFrame       # targets x ratios
    synthetic: DataFrame  # scored synthetic posts of all ratios


def default_scorer(experiment: Experiment) -> Callable[[Column], Column]:
    return partial(
        lexicon_probabilities, positive=experiment.positive_words, negative=experiment.negative_words,
    )


def _observed_windows(scored: DataFrame, experiment: Experiment) -> DataFrame:
    """Baseline, amplified and jittered windows with the row weights that merging needs."""
    sweep = experiment.sweep
    require_columns(scored.columns, ["tweet_id", "timestamp", "cryptocurrency", "finbert_label", "sentiment_score"])
    confidence = clean_double("sentiment_confidence") if "sentiment_confidence" in scored.columns else F.lit(None).cast("double")
    synthetic = F.col("is_synthetic") if "is_synthetic" in scored.columns else F.lit(False)
    # One draw per post serves all jitters, so it is taken before the post is expanded.
    posts = scored.where("timestamp IS NOT NULL").select(
        "timestamp", "cryptocurrency", "finbert_label", synthetic.alias("is_synthetic"),
        clean_double("sentiment_score").alias("_score"), confidence.alias("_confidence"),
        keyed_draw(sweep.seed, "jitter", "tweet_id").alias("_draw"),
    )
    slots = ["struct(0 AS minutes, timestamp AS time)"] + [
        f"struct({m} AS minutes, timestamp + make_dt_interval(0, 0, int(pmod(_draw, {2 * m + 1}) - {m})) AS time)"
        for m in sweep.jitters
    ]
    expanded = posts.selectExpr(
        "cryptocurrency", "finbert_label", "is_synthetic", "_score", "_confidence", f"inline(array({', '.join(slots)}))",
    )
    readings = {"r0": "_score"} | {
        f"r{i}": f"if(minutes = 0 AND _score IS NOT NULL, greatest(-1D, least(1D, _score * {f}D)), NULL)"
        for i, f in enumerate(sweep.factors, start=1)
    }
    statistics = [
        f"{fn.format(value)} AS {prefix}_{name}" for name, value in readings.items()
        for prefix, fn in (("mean", "avg({})"), ("std", "stddev_pop({})"), ("abs", "avg(abs({}))"))
    ]
    grouped = expanded.groupBy("minutes", "cryptocurrency", F.window("time", experiment.freq).alias("_window")).agg(*exprs(
        *COUNTS, "count(_score) AS _scored", "count(_confidence) AS _confident",
        "avg(_confidence) AS mean_sentiment_confidence", *statistics,
    ))

    def reading(dataset: str, name: str) -> str:
        return (
            f"struct('{dataset}' AS dataset, mean_{name} AS mean_sentiment_score, std_{name} AS sentiment_std,"
            f" abs_{name} AS sentiment_intensity)"
        )

    same = [reading(BASELINE, "r0")] + [
        reading(sweep.name("sentiment", f), f"r{i}") for i, f in enumerate(sweep.factors, start=1)
    ]
    moved = " ".join(f"WHEN {m} THEN array({reading(sweep.name("jitter", m), 'r0')})" for m in sweep.jitters)
    return grouped.selectExpr(
        "cryptocurrency", "_window.start AS window_start", "_window.end AS window_end", *_COUNTS, *_WEIGHTS,
        "mean_sentiment_confidence", f"inline(CASE minutes WHEN 0 THEN array({', '.join(same)}) {moved} END)",
    )


def _synthetic_windows(synthetic: DataFrame, freq: str) -> DataFrame:
    """Counts and score statistics of the synthetic posts alone."""
    clean = synthetic.withColumns({c: clean_double(c) for c in ("sentiment_score", "sentiment_confidence")})
    grouped = clean.groupBy("dataset", "cryptocurrency", F.window("timestamp", freq).alias("_window")).agg(*exprs(
        *[text.replace(" AS ", " AS s_") for text in COUNTS], "count(sentiment_score) AS s_scored",
        "count(sentiment_confidence) AS s_confident", "avg(sentiment_score) AS s_mean",
        "var_pop(sentiment_score) AS s_var", "avg(abs(sentiment_score)) AS s_abs",
        "avg(sentiment_confidence) AS s_confidence",
    ))
    return grouped.withColumn("window_start", F.col("_window.start")).drop("_window")


def _merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Windows of two disjoint sets of posts as if aggregated together (pooled mean and variance)."""
    def pooled(mine: str, other: str, weight: str = "_scored", added: str = "s_scored") -> str:
        # A side without readings has no mean and weighs nothing; without any reading the result is null.
        return f"try_divide(coalesce({mine}, 0D) * {weight} + coalesce({other}, 0D) * {added}, {weight} + {added})"

    apart = "if(_scored = 0 OR s_scored = 0, 0D, pow(mean_sentiment_score - s_mean, 2) * _scored * s_scored / (_scored + s_scored))"
    variance = f"{pooled('pow(sentiment_std, 2)', 's_var')} + try_divide({apart}, _scored + s_scored)"
    updates = {
        "mean_sentiment_score": pooled("mean_sentiment_score", "s_mean"),
        "sentiment_std": f"sqrt({variance})",
        "sentiment_intensity": pooled("sentiment_intensity", "s_abs"),
        "mean_sentiment_confidence": pooled("mean_sentiment_confidence", "s_confidence", "_confident", "s_confident"),
        **{c: f"{c} + s_{c}" for c in _COUNTS},
    }
    # Synthetic windows are bounded by targets per topic times ratios, whatever the size of the stream.
    joined = base.join(F.broadcast(extra), ["dataset", "cryptocurrency", "window_start"], "left")
    return joined.selectExpr(
        "dataset", "cryptocurrency", "window_start", "window_end",
        *[f"if(s_tweet_count IS NULL, {c}, {new}) AS {c}" for c, new in updates.items()],
    )


def run_sweep(
    scored: DataFrame, experiment: Experiment = Experiment(), probabilities: Callable[[Column], Column] | None = None,
) -> SweepTables:
    """Windows of every dataset of the sweep.

    The one pass over the posts is staged as a table of windows; target choice, injection and everything
    downstream read that table.
    """
    sweep = experiment.sweep
    observed = stage(
        describe_windows(_observed_windows(scored, experiment), experiment.regimes, ("dataset", *_WEIGHTS)), "windows",
    )
    baseline = observed.where(F.col("dataset") == BASELINE)
    targets = select_targets(baseline.select(*WINDOW_COLUMNS), experiment.targets)
    plan = injection_plan(targets, sweep, experiment.targets)
    synthetic = add_scores(inject_posts(plan, sweep.seed), probabilities or default_scorer(experiment))
    names = F.array(*[F.lit(sweep.name("injection", r)) for r in sweep.ratios])
    copies = baseline.withColumn("dataset", F.explode(names))
    injected = describe_windows(
        _merged(copies, _synthetic_windows(synthetic, experiment.freq)), experiment.regimes, ("dataset",),
    )
    columns = ["dataset", *WINDOW_COLUMNS]
    windows = observed.select(*columns).unionByName(injected.select(*columns))
    return SweepTables(windows, targets, plan, synthetic)


def run_sweep_rows(
    scored: DataFrame, experiment: Experiment = Experiment(), probabilities: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Posts of every dataset of the sweep in one long table."""
    baseline = window_features(scored, experiment.freq, experiment.regimes)
    targets = stage(select_targets(baseline, experiment.targets), "targets")
    plan = injection_plan(targets, experiment.sweep, experiment.targets)
    synthetic = add_scores(inject_posts(plan, experiment.sweep.seed), probabilities or default_scorer(experiment))
    return sweep_rows(scored, synthetic, experiment.sweep)
