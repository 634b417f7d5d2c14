"""Windows and decisions as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiltmeter.config import RegimeRules, WindowPolicy
from tiltmeter.operators.decisions import rule_agent
from tiltmeter.operators.windows import window_features


def decide_stream(
    posts: DataFrame, freq: str, max_delay: str, policy: WindowPolicy = WindowPolicy(),
    rules: RegimeRules = RegimeRules(),
) -> DataFrame:
    """Decisions for windows that the watermark has closed.

    State is one aggregation buffer per open (topic, window), so it is bounded by the delay, not by the
    stream. `max_delay` should cover the largest jitter of the source.
    """
    return rule_agent(window_features(posts.withWatermark("timestamp", max_delay), freq, rules), policy)


def unique_posts(posts: DataFrame, max_delay: str, keys: tuple[str, ...] = ("tweet_id",)) -> DataFrame:
    """A stream in which every post counts once: repeats of `keys` within `max_delay` of the first are dropped.

    State is one entry per key until the watermark has passed the first one by `max_delay`, when a timer removes it.
    """
    return posts.withWatermark("timestamp", max_delay).dropDuplicatesWithinWatermark(list(keys))


def decide_unique(
    posts: DataFrame, freq: str, max_delay: str, keys: tuple[str, ...] = ("tweet_id",), policy: WindowPolicy = WindowPolicy(),
    rules: RegimeRules = RegimeRules(),
) -> DataFrame:
    """`decide_stream` on a source that delivers some posts more than once, two chained states on one watermark."""
    return rule_agent(window_features(unique_posts(posts, max_delay, keys), freq, rules), policy)


def start_decisions(decisions: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append closed windows to a Parquet folder; `once` drains what is there and stops."""
    writer = decisions.writeStream.outputMode("append").format("parquet").options(
        path=path, checkpointLocation=checkpoint,
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def zoned(posts: DataFrame) -> DataFrame:
    """Watermarks need a zoned time; wall-clock times are read in the session zone."""
    return posts.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
