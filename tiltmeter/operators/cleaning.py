"""From raw posts to one clean row per post and topic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.config import BASELINE, TOPICS, require_columns
from tiltmeter.functions.text import HAS_TEXT, detect_topics, normalize_text, parse_tags
from tiltmeter.schemas import CLEAN_POST

ID_COLUMNS = ("", "_c0", "Unnamed: 0", "index")
SOURCE_NAME = "crypto_10k"


def source_row_id(df: DataFrame) -> Column:
    """First id column that has a value; without one, a hash of the row's content.

    A row position would change with the partitioning, the content does not.
    """
    present = [F.col(f"`{c}`").cast("string") for c in ID_COLUMNS if c and c in df.columns]
    content = [F.col(c).cast("string") for c in ("Date", "Content", "Hashtags", "URL", "Username") if c in df.columns]
    return F.coalesce(*present, F.xxhash64(*content).cast("string"))


def _as_time(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name)
    return F.try_to_timestamp(F.col(name))


def prepare_posts(df: DataFrame) -> DataFrame:
    """Typed, normalised posts; rows without a readable time or any text are dropped."""
    require_columns(df.columns, ["Date", "Content"])

    def optional(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    time = _as_time(df, "Date")
    # Both filters look at the raw fields: a filter on the normalised text would normalise every text twice.
    return (
        df.where(time.isNotNull() & F.coalesce(F.col("Content"), F.lit("")).rlike(HAS_TEXT))
        .select(
            source_row_id(df).alias("source_row_id"), time.alias("timestamp"),
            normalize_text("Content").alias("tweet_text"), parse_tags(optional("Hashtags")).alias("hashtags"),
            optional("URL").alias("url"), optional("Username").alias("username"),
            *[c for c in df.columns if c.startswith("_source_")],
        )
    )


def explode_topics(
    posts: DataFrame, topics: Mapping[str, Sequence[str]] = TOPICS, *, explode_multi_topic: bool = True,
) -> DataFrame:
    """One row per post and detected topic, or one row under a joined symbol; posts without a topic go."""
    topics_found = detect_topics(F.col("hashtags"), F.col("tweet_text"), topics)
    # The outer form keeps the optimizer from adding a size filter that would run the detection again.
    named = F.explode_outer(topics_found) if explode_multi_topic else F.nullif(F.array_join(topics_found, "_"), F.lit(""))
    return (
        posts.select("*", named.alias("cryptocurrency")).where(F.col("cryptocurrency").isNotNull())
        .withColumn("tweet_id", F.concat_ws(":", "source_row_id", "cryptocurrency"))
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in a stated order.

    The rank filter is applied inside every task before the shuffle, so a key with many copies sends one row
    per task.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") == 1).drop("_rank")


def clean_posts(
    raw: DataFrame, topics: Mapping[str, Sequence[str]] = TOPICS, *, explode_multi_topic: bool = True,
    source: str = SOURCE_NAME, sort: bool = True,
) -> DataFrame:
    """Raw posts to the clean-post schema, distinct on (id, topic), in time order if `sort`."""
    exploded = explode_topics(prepare_posts(raw), topics, explode_multi_topic=explode_multi_topic)
    by_source = [c for c in exploded.columns if c.startswith("_source_")]
    unique = keep_first(
        exploded, ["tweet_id", "cryptocurrency"], [*by_source, "timestamp", F.xxhash64("tweet_text"), "tweet_text"],
    )
    clean = unique.withColumns({
        "is_synthetic": F.lit(False),
        "mutation_type": F.lit(BASELINE),
        "adversarial_direction": F.lit(""),
        "target_window_id": F.lit(""),
        "source": F.lit(source),
    }).select(*CLEAN_POST.names)
    return clean.orderBy("timestamp", "cryptocurrency", "tweet_id") if sort else clean
