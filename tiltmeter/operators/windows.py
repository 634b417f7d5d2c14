"""Tumbling-window features, regimes and the summaries built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.config import LABELS, NegativeCuts, RegimeRules, require_columns
from tiltmeter.functions.numeric import clean_double, share_text
from tiltmeter.functions.quantiles import percentiles_of

WINDOW_COLUMNS = (
    "window_id", "window_start", "window_end", "cryptocurrency", "tweet_count", "synthetic_count",
    "positive_count", "neutral_count", "negative_count", "positive_ratio", "neutral_ratio", "negative_ratio",
    "mean_sentiment_score", "sentiment_std", "sentiment_intensity", "mean_sentiment_confidence",
    "dominant_label", "regime",
)


WINDOW_ID = "concat_ws('_', cryptocurrency, date_format(window_start, \"yyyyMMdd'T'HHmmss'Z'\"))"

# Counts of a group of posts.
COUNTS = (
    "count(1) AS tweet_count",
    "count_if(coalesce(is_synthetic, false)) AS synthetic_count",
    *[f"count_if(lower(finbert_label) = '{name}') AS {name}_count" for name in LABELS],
)


def exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]


def regime(rules: RegimeRules = RegimeRules()) -> Column:
    """First matching description of a window's mood."""
    return F.expr(f"""
        CASE WHEN tweet_count < {rules.min_posts} THEN 'sparse'
             WHEN positive_ratio >= {rules.conflict_ratio}D AND negative_ratio >= {rules.conflict_ratio}D THEN 'high_conflict'
             WHEN abs(mean_sentiment_score) <= {rules.neutral_abs_mean}D AND positive_ratio < {rules.neutral_max_ratio}D
              AND negative_ratio < {rules.neutral_max_ratio}D THEN 'neutral'
             WHEN positive_ratio >= {rules.skew_ratio}D THEN 'positive_skew'
             WHEN negative_ratio >= {rules.skew_ratio}D THEN 'negative_skew'
             ELSE 'mixed' END""")


def describe_windows(df: DataFrame, rules: RegimeRules = RegimeRules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Complete grouped windows (start, end, counts, score statistics) with id, ratios, label and regime."""
    ratios = [f"if(tweet_count > 0, {name}_count / tweet_count, 0D) AS {name}_ratio" for name in LABELS]
    told = df.selectExpr(
        *keep, f"{WINDOW_ID} AS window_id", "window_start", "window_end", "cryptocurrency", "tweet_count",
        "synthetic_count", *[f"{name}_count" for name in LABELS], *ratios, "mean_sentiment_score", "sentiment_std",
        "sentiment_intensity", "mean_sentiment_confidence",
        """CASE greatest(positive_count, neutral_count, negative_count)
           WHEN positive_count THEN 'positive' WHEN neutral_count THEN 'neutral' ELSE 'negative' END AS dominant_label""",
    )
    return told.withColumn("regime", regime(rules))


def window_features(df: DataFrame, freq: str, rules: RegimeRules = RegimeRules()) -> DataFrame:
    """One row per (dataset if present, topic, window).

    The window start is part of the grouping key, so a topic that dominates the stream still spreads over all
    tasks, and the aggregates combine map-side before the only shuffle.
    """
    require_columns(df.columns, ["timestamp", "cryptocurrency", "finbert_label", "sentiment_score"])
    if "is_synthetic" not in df.columns:
        df = df.withColumn("is_synthetic", F.lit(False))
    if "sentiment_confidence" not in df.columns:
        df = df.withColumn("sentiment_confidence", F.lit(None).cast("double"))
    keys = ["dataset"] if "dataset" in df.columns else []
    score, confidence = clean_double("sentiment_score"), clean_double("sentiment_confidence")
    grouped = (
        df.where(F.col("timestamp").isNotNull())
        .select(*keys, "timestamp", "cryptocurrency", "finbert_label", "is_synthetic",
                score.alias("_score"), confidence.alias("_confidence"))
        .groupBy(*keys, "cryptocurrency", F.window("timestamp", freq).alias("_window"))
        .agg(
            *exprs(
                *COUNTS, "avg(_score) AS mean_sentiment_score", "stddev_pop(_score) AS sentiment_std",
                "avg(abs(_score)) AS sentiment_intensity", "avg(_confidence) AS mean_sentiment_confidence",
            )
        )
        .withColumns({"window_start": F.col("_window.start"), "window_end": F.col("_window.end")})
    )
    return describe_windows(grouped, rules, keep=tuple(keys))


def regime_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("cryptocurrency", "regime").agg(F.count(F.lit(1)).alias("windows"))


def busiest_windows(windows: DataFrame, n: int = 12) -> DataFrame:
    """First n windows by topic, then size; the window start settles ties."""
    return windows.orderBy("cryptocurrency", F.desc("tweet_count"), "window_start").limit(n)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and share of the whole per distinct combination."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count")).scalar()
    return counted.withColumn("share", F.col("count") / total)


def load_summary(windows: DataFrame, topics: tuple[str, ...] = ("BTC", "ETH")) -> DataFrame:
    """Per dataset: posts, windows, windows per topic, mean and sample deviation of the window means."""
    return windows.groupBy("dataset").agg(
        F.sum("tweet_count").alias("tweet_rows"),
        F.count(F.lit(1)).alias("windows"),
        *[F.count_if(F.col("cryptocurrency") == t).alias(f"{t}_windows") for t in topics],
        F.bround(F.avg("mean_sentiment_score"), 4).alias("mean_window_sentiment"),
        F.bround(F.stddev_samp("mean_sentiment_score"), 4).alias("std_window_sentiment"),
    )


def negative_summary(windows: DataFrame) -> DataFrame:
    """Per dataset: spread of the mean score and of the negative ratio, and how many windows lean negative.

    Reads `windows` twice: once for all aggregates and sketches, once for the brackets."""
    total = F.col("windows")
    summary = percentiles_of(
        windows, ["dataset"],
        {"mean_sentiment_p10": ("mean_sentiment_score", 0.1), "mean_sentiment_median": ("mean_sentiment_score", 0.5),
         "negative_ratio_p90": ("negative_ratio", 0.9)},
        {"windows": F.count(F.lit(1)),
         "mean_sentiment_avg": F.bround(F.avg("mean_sentiment_score"), 4),
         "mean_sentiment_min": F.bround(F.min("mean_sentiment_score"), 4),
         "negative_ratio_avg": F.bround(F.avg("negative_ratio"), 4),
         "negative_ratio_max": F.bround(F.max("negative_ratio"), 4),
         "_dominant": F.count_if(F.col("dominant_label") == "negative"),
         "_skew": F.count_if(F.col("regime") == "negative_skew"),
         "_conflict": F.count_if(F.col("regime") == "high_conflict")},
    )
    return (
        summary.select(
            "dataset", "windows", "mean_sentiment_avg", "mean_sentiment_min",
            F.bround("mean_sentiment_p10", 4).alias("mean_sentiment_p10"),
            F.bround("mean_sentiment_median", 4).alias("mean_sentiment_median"),
            "negative_ratio_avg",
            F.bround("negative_ratio_p90", 4).alias("negative_ratio_p90"),
            "negative_ratio_max",
            share_text(F.col("_dominant"), total).alias("dominant_negative"),
            share_text(F.col("_skew"), total).alias("negative_skew"),
            share_text(F.col("_conflict"), total).alias("high_conflict"),
        )
    )


def negative_thresholds(windows: DataFrame, cuts: NegativeCuts = NegativeCuts()) -> DataFrame:
    """Per dataset: how many windows pass each negative cut-off, as `n/total (p%)`."""
    mean, ratio = F.col("mean_sentiment_score"), F.col("negative_ratio")
    tests = {f"mean_sentiment <= {c:+.2f}": mean <= c for c in cuts.mean_at_most}
    tests |= {f"negative_ratio >= {c:.2f}": ratio >= c for c in cuts.ratio_at_least}
    tests["strong_negative_candidate"] = (mean <= cuts.strong_mean) | (ratio >= cuts.strong_ratio)
    total = F.count(F.lit(1))
    return windows.groupBy("dataset").agg(
        total.alias("windows"), *[share_text(F.count_if(test), total).alias(name) for name, test in tests.items()]
    )


def most_negative(windows: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest windows of each dataset; ranks are cut map-side before the shuffle."""
    order = Window.partitionBy("dataset").orderBy(
        F.asc_nulls_last("mean_sentiment_score"), F.desc("negative_ratio"), "window_id",
    )
    return (
        windows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
        .select(
            "dataset", "window_id", "window_start", "cryptocurrency", "tweet_count", "positive_count",
            "neutral_count", "negative_count", "positive_ratio", "neutral_ratio", "negative_ratio",
            "mean_sentiment_score", "sentiment_std", "dominant_label", "regime",
        )
    )
