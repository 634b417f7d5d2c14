"""Choice of target windows and generation of synthetic posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.config import DEFAULT_TEXT_SYMBOL, SYNTHETIC_TEXTS, Sweep, TargetRules
from tiltmeter.functions.numeric import keyed_draw
from tiltmeter.operators.perturb import mark_injected_original
from tiltmeter.operators.scoring import add_scores

POSITIVE, NEGATIVE = "positive_injection", "negative_injection"


def select_targets(windows: DataFrame, rules: TargetRules = TargetRules()) -> DataFrame:
    """Large, near-neutral windows, at most `per_topic` per topic, with an injection direction.

    If no window is near-neutral, all large ones compete. Both rankings are cut in one pass: the top rows per
    (topic, near-neutral or not) are kept, map-side first, and the flag is settled on those few rows.
    """
    leaders = windows.selectExpr(
        "*", "abs(mean_sentiment_score) AS abs_mean_sentiment_score",
        f"coalesce(abs(mean_sentiment_score) <= {rules.max_abs_mean}D, false) AS _near",
    ).where(f"tweet_count >= {rules.min_posts}").withColumn("_rank", F.expr("""
        row_number() OVER (PARTITION BY cryptocurrency, _near ORDER BY tweet_count DESC,
            abs_mean_sentiment_score NULLS LAST, sentiment_intensity NULLS LAST, window_start)""",
    )).where(f"_rank <= {rules.per_topic}")
    # At most 2 * per_topic rows per topic are left from here on, so they may share one task.
    chosen = leaders.withColumn("_any_near", F.expr("max(_near) OVER ()")).where("_near = _any_near")
    directed = chosen.withColumn("adversarial_direction", F.expr(f"""
        if(row_number() OVER (PARTITION BY cryptocurrency ORDER BY mean_sentiment_score NULLS LAST, window_start)
           <= ceil(count(1) OVER (PARTITION BY cryptocurrency) / 2), '{POSITIVE}', '{NEGATIVE}')"""))
    return directed.withColumn("adversarial_direction", F.expr(f"""
        CASE WHEN count(1) OVER () < 2 OR min(adversarial_direction) OVER () <> max(adversarial_direction) OVER ()
             THEN adversarial_direction
             WHEN row_number() OVER (ORDER BY mean_sentiment_score NULLS LAST, cryptocurrency, window_start)
                  <= ceil(count(1) OVER () / 2) THEN '{POSITIVE}'
             ELSE '{NEGATIVE}' END""")).drop("_near", "_any_near", "_rank")


def synthetic_count(posts: Column, ratio: Column, rules: TargetRules = TargetRules()) -> Column:
    return F.least(
        F.lit(rules.max_synthetic), F.greatest(F.lit(rules.min_synthetic), F.ceil(posts * ratio)),
    ).cast("bigint")


def injection_plan(targets: DataFrame, sweep: Sweep = Sweep(), rules: TargetRules = TargetRules()) -> DataFrame:
    """Targets times ratios with the number of posts each gets."""
    ratios = F.array(*[
        F.struct(F.lit(sweep.name("injection", r)).alias("dataset"), F.lit(float(r)).alias("nominal_injection_ratio"))
        for r in sweep.ratios
    ])
    return (
        targets.drop("synthetic_count").withColumn("_r", F.explode(ratios))
        .withColumns({
            "dataset": F.col("_r.dataset"),
            "nominal_injection_ratio": F.col("_r.nominal_injection_ratio"),
            "original_tweet_count": F.col("tweet_count"),
        }).drop("_r")
        .withColumn("synthetic_count", synthetic_count(F.col("tweet_count"), F.col("nominal_injection_ratio"), rules))
        .withColumns({
            "actual_injection_ratio": F.col("synthetic_count") / F.col("original_tweet_count"),
            "cap_hit": F.col("synthetic_count") >= rules.max_synthetic,
        })
    )


def _texts() -> str:
    """SQL map of SYMBOL_polarity to its texts."""
    entries = [
        f"'{symbol}_{polarity}', array(" + ", ".join(f"'{body}'" for body in texts) + ")"
        for (symbol, polarity), texts in SYNTHETIC_TEXTS.items()
    ]
    return f"map({', '.join(entries)})"


def inject_posts(plan: DataFrame, seed: int = Sweep.seed) -> DataFrame:
    """Synthetic posts of a plan: random second inside the target window, random text of its polarity.

    Offsets run from 1 to length - 1, so every post stays in its window.
    """
    numbered = plan.where("synthetic_count > 0").selectExpr(
        "*", "synthetic_count AS synthetic_count_target", "format_string('%.2f', nominal_injection_ratio) AS _ratio",
        f"if(adversarial_direction = '{POSITIVE}', 'positive', 'negative') AS _polarity",
        "explode(sequence(0L, synthetic_count - 1)) AS _i",
    )
    named = numbered.selectExpr(
        "*", "concat_ws(':', 'synthetic:combined_adversarial', concat('r', _ratio), adversarial_direction, window_id,"
             " string(_i)) AS tweet_id",
        f"coalesce(try_element_at({_texts()}, concat_ws('_', cryptocurrency, _polarity)),"
        f" try_element_at({_texts()}, concat_ws('_', '{DEFAULT_TEXT_SYMBOL}', _polarity))) AS _options",
        "greatest(2L, timestampdiff(SECOND, window_start, window_end)) AS _seconds",
    ).withColumns({
        "_offset": keyed_draw(seed, "offset", "tweet_id"), "_pick": keyed_draw(seed, "text", "tweet_id"),
    })
    return named.selectExpr(
        "dataset", "tweet_id", "tweet_id AS source_row_id",
        "window_start + make_dt_interval(0, 0, 0, pmod(_offset, _seconds - 1) + 1) AS timestamp",
        "cryptocurrency", "element_at(_options, int(pmod(_pick, size(_options)) + 1)) AS tweet_text",
        "array(cryptocurrency, if(cryptocurrency = 'BTC', 'Bitcoin', 'Ethereum'), 'crypto') AS hashtags",
        "'' AS url", "concat('synthetic_', _polarity) AS username", "true AS is_synthetic",
        "concat('combined_adversarial_injection_r', _ratio) AS mutation_type", "adversarial_direction",
        "window_id AS target_window_id", "'synthetic_adversarial' AS source",
        "concat_ws('_', cryptocurrency, _polarity) AS synthetic_template_id", "nominal_injection_ratio",
        "original_tweet_count", "synthetic_count_target", "actual_injection_ratio", "cap_hit",
        "'injection' AS sweep_family", "nominal_injection_ratio AS sweep_strength",
    )


def injected_dataset(
    scored: DataFrame, synthetic: DataFrame, ratio: float, probabilities: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Relabelled baseline plus scored synthetic posts of one ratio, in time order.

    `synthetic` is scored here when `probabilities` is given, else it must be scored already.
    """
    name = Sweep.name("injection", ratio)
    extra = synthetic.where(F.col("dataset") == name).drop("dataset")
    if probabilities is not None:
        extra = add_scores(extra, probabilities)
    both = mark_injected_original(scored, ratio).unionByName(extra, allowMissingColumns=True)
    return both.orderBy("timestamp", "cryptocurrency", "tweet_id")
