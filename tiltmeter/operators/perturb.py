"""Perturbations of a scored stream, one at a time or as a whole sweep in one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.config import BASELINE, EMPHASIS_PREFIX, NO_FEED_TEXT, Sweep
from tiltmeter.functions.labels import score_from_label
from tiltmeter.functions.numeric import clean_double, clip, keyed_draw
from tiltmeter.functions.ordering import BLOCK, over_previous_rows


def amplified(score: Column, factor: float) -> Column:
    return clip(score * F.lit(float(factor)), -1.0, 1.0)


def amplify(df: DataFrame, factor: float) -> DataFrame:
    """Scale the score within [-1, 1] and keep the original. Labels stay as they were: the experiment is
    about decisions that read the score."""
    return df.withColumn("sentiment_score_original", clean_double("sentiment_score")).withColumns({
        "sentiment_score": amplified(F.col("sentiment_score_original"), factor),
        "mutation_type": F.lit(Sweep.mutation("sentiment", factor)),
        "is_synthetic": F.lit(False),
        "sweep_family": F.lit("sentiment"),
        "sweep_strength": F.lit(float(factor)),
    })


def shift_minutes(max_minutes: int, seed: int, id_col: str = "tweet_id") -> Column:
    """Whole minutes in [-max, max], drawn from the row's id."""
    return (F.pmod(keyed_draw(seed, "jitter", id_col), F.lit(2 * max_minutes + 1)) - max_minutes).cast("int")


def moved(time: Column, minutes: Column) -> Column:
    return time + F.make_dt_interval(mins=minutes)


def time_jitter(df: DataFrame, max_minutes: int, seed: int = Sweep.seed, id_col: str = "tweet_id") -> DataFrame:
    """Move every event by a random number of minutes and keep the original time."""
    return df.withColumn("timestamp_original", F.col("timestamp")).withColumn(
        "time_shift_minutes", shift_minutes(max_minutes, seed, id_col),
    ).withColumns({
        "timestamp": moved(F.col("timestamp_original"), F.col("time_shift_minutes")),
        "mutation_type": F.lit(f"temporal_jitter_pm{int(max_minutes)}min"),
        "is_synthetic": F.lit(False),
        "sweep_family": F.lit("jitter"),
        "sweep_strength": F.lit(float(max_minutes)),
    })


def mark_injected_original(df: DataFrame, ratio: float) -> DataFrame:
    """The untouched half of an injected dataset."""
    marked = df.withColumns({
        "mutation_type": F.lit(Sweep.mutation("injection", ratio)),
        "is_synthetic": F.lit(False),
        "sweep_family": F.lit("injection"),
        "sweep_strength": F.lit(float(ratio)),
    })
    for name in ("adversarial_direction", "target_window_id"):
        if name not in marked.columns:
            marked = marked.withColumn(name, F.lit(""))
    return marked


def sweep_rows(scored: DataFrame, synthetic: DataFrame | None, sweep: Sweep = Sweep()) -> DataFrame:
    """Every dataset of the sweep as rows of one table.

    The stream is read once; each row is expanded to its variants inside the task, so the expansion adds no
    shuffle. `synthetic` holds the scored posts of all injected datasets (with a `dataset` column).
    """
    null_double, null_int = F.lit(None).cast("double"), F.lit(None).cast("int")
    score, time = F.col("_score"), F.col("timestamp")

    def variant(name, family, strength, kind, *, new_score=score, original=null_double, shift=null_int, new_time=time):
        return F.struct(
            F.lit(name).alias("dataset"), F.lit(family).alias("sweep_family"),
            F.lit(float(strength)).alias("sweep_strength"), F.lit(kind).alias("mutation_type"),
            new_score.alias("sentiment_score"), original.alias("sentiment_score_original"),
            new_time.alias("timestamp"), shift.alias("time_shift_minutes"),
        )

    variants = [variant(BASELINE, BASELINE, 0.0, BASELINE)]
    for factor in sweep.factors:
        variants.append(variant(
            sweep.name("sentiment", factor), "sentiment", factor, Sweep.mutation("sentiment", factor),
            new_score=amplified(score, factor), original=score,
        ))
    for minutes in sweep.jitters:
        shift = F.col(f"_shift_{minutes}")
        variants.append(variant(
            sweep.name("jitter", minutes), "jitter", minutes, f"temporal_jitter_pm{minutes}min",
            shift=shift, new_time=moved(time, shift),
        ))
    for ratio in sweep.ratios:
        variants.append(variant(
            sweep.name("injection", ratio), "injection", ratio, Sweep.mutation("injection", ratio),
        ))

    replaced = {"sentiment_score", "timestamp", "mutation_type", "is_synthetic", "sweep_family", "sweep_strength",
                "sentiment_score_original", "time_shift_minutes", "dataset"}
    carried = [c for c in scored.columns if c not in replaced]
    expanded = (
        scored.withColumn("_score", clean_double("sentiment_score"))
        .withColumns({f"_shift_{m}": shift_minutes(m, sweep.seed) for m in sweep.jitters})
        .select(*carried, F.explode(F.array(*variants)).alias("_v"))
        .select(*carried, "_v.*", F.lit(False).alias("is_synthetic"))
    )
    if synthetic is None:
        return expanded
    return expanded.unionByName(synthetic, allowMissingColumns=True)


def emphasize(steps: DataFrame, factor: float = 2.0, *, rederive: bool = True, block: int = BLOCK) -> DataFrame:
    """Louder feed: marker before the text, amplified score, market columns derived again."""
    louder = steps.withColumns({
        "social_sentiment_score": amplified(F.col("social_sentiment_score"), factor),
        "tweet_text": F.concat(F.lit(EMPHASIS_PREFIX), F.col("tweet_text")),
    })
    return derive_market(louder, block=block) if rederive else louder


def amplify_steps(steps: DataFrame, factor: float = 2.0) -> DataFrame:
    """Scaled step sentiment within [-1, 1]."""
    return steps.withColumn("social_sentiment_score", amplified(F.col("social_sentiment_score"), factor))


def row_lag(
    steps: DataFrame, rows: int = 3, numeric: str | None = "news_impact_score", text: str | None = None,
    step: str = "step", block: int = BLOCK,
) -> DataFrame:
    """Delay columns by a number of rows of the dense `step` order.

    Numeric gaps at the start take the column mean, text gaps a placeholder.
    """
    def lagged(spec: Window) -> dict[str, Column]:
        if not numeric:
            return {}
        mean = steps.agg(F.avg(numeric)).scalar()
        return {numeric: F.coalesce(F.lag(numeric, rows).over(spec), mean)}

    late = over_previous_rows(steps, step, rows, lagged, block, reads=[numeric] if numeric else [])
    if not text:
        return late
    # A lag over dense steps is a lookup by position, so texts need no frame.
    earlier = steps.select((F.col(step) + rows).alias(step), F.col(text).alias("_earlier"))
    fed = late.drop(text).join(earlier, step, "left").withColumn(text, F.coalesce("_earlier", F.lit(NO_FEED_TEXT)))
    return fed.select(*late.columns)


def derive_market(df: DataFrame, step: str = "step", block: int = BLOCK) -> DataFrame:
    """Market columns from the score of a step and the ones before it."""
    score = "social_sentiment_score"

    def rolling(spec: Window) -> dict[str, Column]:
        return {
            "rsi_technical_indicator": clip(50 + F.avg(score).over(spec.rowsBetween(-13, 0)) * 50, 0.0, 100.0),
            "volatility_index": clip(
                F.coalesce(F.stddev_samp(score).over(spec.rowsBetween(-9, 0)), F.lit(0.0)) * 100, 0.0, 100.0,
            ),
            "price_change_24h_percent": F.coalesce(F.lag(score, 1).over(spec), F.lit(0.0)) * 3.0,
        }

    return over_previous_rows(df, step, 13, rolling, block, reads=[score])


def market_frame(posts: DataFrame, step: str = "step", block: int = BLOCK) -> DataFrame:
    """Market steps from labelled posts: score by label, rolling strength, volatility and price signal."""
    scored = posts.withColumn("social_sentiment_score", score_from_label(F.col("label")))
    scored = scored.withColumns({
        "news_impact_score": F.col("social_sentiment_score"), "current_price_usd": F.lit(100.0),
    })
    return derive_market(scored, step, block)
