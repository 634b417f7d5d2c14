"""Window features as partial states that are kept and merged, so new posts never make old ones be read again.

A state holds, per (dataset if present, topic, window): the counts, and for scores and confidences their number, mean and
sum of squared deviations. States of disjoint sets of posts merge into the state of their union (pooled mean and
deviation, which stays exact where a sum of squares would cancel), in any order and any number of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.config import LABELS, RegimeRules, require_columns
from tiltmeter.functions.numeric import clean_double
from tiltmeter.operators.windows import COUNTS, describe_windows, exprs
from tiltmeter.sources.versions import VersionedTable

_COUNTED = ("tweet_count", "synthetic_count", *[f"{name}_count" for name in LABELS])


def window_state(posts: DataFrame, freq: str) -> DataFrame:
    """Partial states of a set of posts; the same grouping as `window_features`."""
    require_columns(posts.columns, ["timestamp", "cryptocurrency", "finbert_label", "sentiment_score"])
    missing = {"is_synthetic": F.lit(False), "sentiment_confidence": F.lit(None).cast("double"), "dataset": F.lit("baseline")}
    posts = posts.withColumns({name: value for name, value in missing.items() if name not in posts.columns})
    ready = posts.where("timestamp IS NOT NULL").withColumns({"_score": clean_double("sentiment_score"), "_confidence": clean_double("sentiment_confidence")})
    grouped = ready.groupBy("dataset", "cryptocurrency", F.window("timestamp", freq).alias("_window")).agg(*exprs(
        *COUNTS, "count(_score) AS scored", "avg(_score) AS score_mean", "var_pop(_score) * count(_score) AS score_spread",
        "avg(abs(_score)) AS size_mean", "count(_confidence) AS confident", "avg(_confidence) AS confidence_mean",
    ))
    return grouped.selectExpr(
        "dataset", "cryptocurrency", "_window.start AS window_start", "_window.end AS window_end", *_COUNTED, "scored", "score_mean", "score_spread", "size_mean",
        "confident", "confidence_mean",
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per window of several partial ones.

    The spread about the pooled mean is the sum of the spreads plus the weighted spread of the means about it. The list of
    means has one entry per load that touched the window since the last compaction.
    """
    keys = ["dataset", "cryptocurrency", "window_start", "window_end"]
    first = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in (*_COUNTED, "scored", "confident")],
        *[F.expr(f"try_divide(sum({mean} * {n}), sum(if({mean} IS NULL, 0, {n})))").alias(mean)
          for mean, n in (("score_mean", "scored"), ("size_mean", "scored"), ("confidence_mean", "confident"))],
        F.sum("score_spread").alias("score_spread"), F.collect_list(F.when(F.col("scored") > 0, F.struct("score_mean", "scored"))).alias("_parts"),
    )
    between = F.expr("aggregate(_parts, 0D, (acc, p) -> acc + pow(p.score_mean - score_mean, 2) * p.scored)")
    return first.withColumn("score_spread", F.col("score_spread") + between).drop("_parts")


def windows_of(states: DataFrame, rules: RegimeRules = RegimeRules()) -> DataFrame:
    """Window features of merged states."""
    named = states.selectExpr(
        "dataset", "cryptocurrency", "window_start", "window_end", *_COUNTED, "score_mean AS mean_sentiment_score",
        "sqrt(try_divide(score_spread, scored)) AS sentiment_std", "size_mean AS sentiment_intensity", "confidence_mean AS mean_sentiment_confidence",
    )
    return describe_windows(named, rules, keep=("dataset",))


STATE = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("cryptocurrency", T.StringType()), T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
    *[T.StructField(c, T.LongType()) for c in (*_COUNTED, "scored")], *[T.StructField(c, T.DoubleType()) for c in ("score_mean", "score_spread", "size_mean")],
    T.StructField("confident", T.LongType()), T.StructField("confidence_mean", T.DoubleType()),
])


class WindowStates:
    """Kept window states: a load adds its posts' states as a batch, readers merge the batches of a version.

    `compact` merges them for good once in a while; until then a window has one row per load that touched it.
    """

    def __init__(self, spark: SparkSession, path: str, freq: str):
        self.table, self.freq = VersionedTable(spark, path, STATE), freq

    def add(self, posts: DataFrame) -> int:
        zoned = window_state(posts, self.freq).withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})
        return self.table.append(zoned, self.table.latest())

    def windows(self, version: int | None = None, rules: RegimeRules = RegimeRules()) -> DataFrame:
        return windows_of(merge_states(self.table.read(version)), rules)

    def compact(self) -> bool:
        since = self.table.latest()
        return bool(since) and self.table.replace(merge_states(self.table.read(since)), since)
