"""Policies and risk overrides that turn windows or steps into BUY, SELL or HOLD."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.config import MODEL_AGENT, RULE_AGENT, CompositeWeights, StepPolicy, WindowPolicy
from tiltmeter.functions.joins import lookup
from tiltmeter.functions.labels import action_from_label, dominant, label_from_score
from tiltmeter.functions.numeric import bucketed, clean_double, clip
from tiltmeter.functions.text import answer_action, strip
from tiltmeter.schemas import TRAJECTORY
from tiltmeter.session import stage

Answer = Callable[[Sequence[str]], Sequence[str]]

# Fixed value: the question put to a model about one window.
WINDOW_QUESTION = (
    "Instruction: Based on the crypto market sentiment data below, what is the trading action?"
    "Please choose an answer from {BUY/HOLD/SELL}Input: %sAnswer: "
)
# The questions put to a model about one post.
SENTIMENT_QUESTION = (
    "Classify the sentiment of this cryptocurrency tweet. "
    "Answer with exactly one word: positive, neutral, or negative.\nTweet: %s"
)
DECISION_QUESTION = (
    "You are a cryptocurrency trading agent. Given the tweet and market conditions "
    "(RSI=%.0f where above 70 is overbought and below 30 is oversold, "
    "Volatility=%.0f out of 100 where above 90 is extreme risk), decide the trading action. "
    "Answer with exactly one word: BUY, HOLD, or SELL.\nTweet: %s"
)


def window_policy(policy: WindowPolicy = WindowPolicy()) -> Column:
    mean = F.col("mean_sentiment_score")
    return F.when(mean > policy.buy_above, "BUY").when(mean < policy.sell_below, "SELL").otherwise("HOLD")


def window_risk(policy: WindowPolicy = WindowPolicy()) -> Column:
    """True when scattered scores and negative posts make a window unreliable."""
    return F.coalesce(
        (F.col("sentiment_std") > policy.risk_std) & (F.col("negative_ratio") > policy.risk_negative), F.lit(False),
    )


def window_text() -> Column:
    """One-line summary of a window; numbers are rounded half to even before formatting."""
    def share(name: str) -> Column:
        return F.bround(F.col(name) * 100, 0)

    return F.format_string(
        "%s: %d tweets, mean_sentiment=%.3f, positive=%.0f%%, neutral=%.0f%%, negative=%.0f%%, sentiment_std=%.3f",
        "cryptocurrency", "tweet_count", F.bround("mean_sentiment_score", 3), share("positive_ratio"),
        share("neutral_ratio"), share("negative_ratio"), F.bround("sentiment_std", 3),
    )


def step_text() -> Column:
    """One sentence about a market step."""
    rsi, pct = F.col("rsi_technical_indicator"), F.col("price_change_24h_percent")
    return F.format_string(
        "%s moved %s %.1f%% with %s social sentiment. RSI is %s at %.1f. Fear and greed index is %.0f.",
        F.col("cryptocurrency"), F.when(pct > 0, "up").otherwise("down"), F.bround(F.abs(pct), 1),
        label_from_score(F.col("social_sentiment_score")),
        F.when(rsi > 70, "overbought").when(rsi < 30, "oversold").otherwise("neutral"), F.bround(rsi, 1),
        F.bround("fear_greed_index", 0),
    )


def decision_question(max_chars: int | None = None) -> Column:
    text = F.col("tweet_text") if max_chars is None else F.left("tweet_text", F.lit(max_chars))
    return F.format_string(
        DECISION_QUESTION, F.bround("rsi_technical_indicator", 0), F.bround("volatility_index", 0), text,
    )


def trajectories(
    windows: DataFrame, choices: Mapping[str, Column], policy: WindowPolicy = WindowPolicy(),
) -> DataFrame:
    """Decisions of several agents over one pass of the windows: own choice, then the risk override.

    `choices` maps an agent to the column with its action.
    """
    if "dataset" not in windows.columns:
        windows = windows.withColumn("dataset", F.lit(""))
    per_agent = F.array(*[
        F.struct(F.lit(agent).alias("agent"), action.alias("policy_action")) for agent, action in choices.items()
    ])
    return windows.select(
        "window_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "cryptocurrency",
        "tweet_count", F.col("mean_sentiment_score").alias("mean_sentiment"), "sentiment_std", "positive_ratio",
        "negative_ratio", "synthetic_count", window_risk(policy).alias("oracle_triggered"), "dataset",
        F.inline(per_agent),
    ).withColumn(
        "action_taken", F.when(F.col("oracle_triggered"), "HOLD").otherwise(F.col("policy_action")),
    ).select(*TRAJECTORY.names)


def rule_agent(windows: DataFrame, policy: WindowPolicy = WindowPolicy()) -> DataFrame:
    return trajectories(windows, {RULE_AGENT: window_policy(policy)}, policy)


def answered(question: Column, factory: Callable[[], Answer], batch_size: int = 64) -> Column:
    """Free-text answers of a model, asked in Arrow batches; the model is built once per task."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = factory()
        for batch in batches:
            texts = batch.fillna("").astype(str).tolist()
            yield pd.Series([a for i in range(0, len(texts), batch_size) for a in answer(texts[i:i + batch_size])])

    return ask(question)


def model_agent(
    windows: DataFrame, answer: Callable[[], Answer] | Column, policy: WindowPolicy = WindowPolicy(),
    agent: str = MODEL_AGENT,
) -> DataFrame:
    """Render each window, ask a model (or take a native answer column), read the action from the reply."""
    return trajectories(*asked(windows, answer, agent), policy)


def asked(
    windows: DataFrame, answer: Callable[[], Answer] | Column, agent: str = MODEL_AGENT,
) -> tuple[DataFrame, dict[str, Column]]:
    """Windows with the model's reply, and the choice read from it, for `trajectories`."""
    if not isinstance(answer, Column):
        answer = answered(F.replace(F.lit(WINDOW_QUESTION), F.lit("%s"), window_text()), answer)
    return windows.withColumn("_answer", answer), {agent: answer_action("_answer")}


def rule_and_model(
    windows: DataFrame, answer: Callable[[], Answer] | Column, policy: WindowPolicy = WindowPolicy(),
) -> DataFrame:
    """Both agents' decisions from one pass over the windows."""
    ready, choice = asked(windows, answer)
    return trajectories(ready, {RULE_AGENT: window_policy(policy)} | choice, policy)


def step_rule(policy: StepPolicy = StepPolicy()) -> Column:
    mood, rsi = clean_double("social_sentiment_score"), clean_double("rsi_technical_indicator")
    return (
        F.when((mood > policy.buy_above) & (rsi < policy.buy_rsi_below), "BUY")
        .when((mood < policy.sell_below) | (rsi > policy.sell_rsi_above), "SELL").otherwise("HOLD")
    )


def step_risk(policy: StepPolicy = StepPolicy()) -> Column:
    volatility = F.col("volatility_index")
    return F.coalesce((volatility > policy.risk_volatility) & ~F.isnan(volatility), F.lit(False))


def composite_parts(weights: CompositeWeights = CompositeWeights()) -> dict[str, Column]:
    """Weighted score of a step with its factors and the label it leads to."""
    mood = clean_double("social_sentiment_score")
    rsi = -(clean_double("rsi_technical_indicator") - 50) / 50
    momentum = clip(clean_double("price_change_24h_percent") / 10.0, -1.0, 1.0)
    greed = (clean_double("fear_greed_index") - 50) / 50
    total = weights.sentiment * mood + weights.rsi * rsi + weights.momentum * momentum + weights.mood * greed
    label = (
        F.when(total > weights.positive_above, "positive").when(total < weights.negative_below, "negative")
        .otherwise("neutral")
    )
    trace = F.format_string(
        "Composite=%+.3f | sentiment=%+.3f(x%.2f) rsi_factor=%+.3f(x%.2f) momentum=%+.3f(x%.2f) "
        "fear_greed=%+.3f(x%.2f) -> %s",
        F.bround(total, 3), F.bround(mood, 3), F.lit(weights.sentiment), F.bround(rsi, 3), F.lit(weights.rsi),
        F.bround(momentum, 3), F.lit(weights.momentum), F.bround(greed, 3), F.lit(weights.mood), label,
    )
    return {"composite": total, "raw_label": label, "reasoning": trace}


def _with_override(steps: DataFrame, agent: str, action: Column, policy: StepPolicy) -> DataFrame:
    return steps.withColumns({"agent": F.lit(agent), "policy_action": action}).withColumns({
        "oracle_triggered": step_risk(policy),
        "action_taken": F.when(step_risk(policy), "HOLD").otherwise(F.col("policy_action")),
    })


STEP_COLUMNS = (
    ("step", "step"), ("timestamp", "timestamp"), ("cryptocurrency", "cryptocurrency"),
    ("social_sentiment_score", "input_sentiment"), ("rsi_technical_indicator", "rsi"),
    ("volatility_index", "volatility"), ("current_price_usd", "price_usd"),
    ("price_change_24h_percent", "price_change_pct"),
)


def _step_log(steps: DataFrame, *extra: str) -> DataFrame:
    """Project a decided step frame to the log columns."""
    return steps.select(
        *[F.col(old).alias(new) for old, new in STEP_COLUMNS if old in steps.columns],
        *extra, "policy_action", "action_taken", "oracle_triggered", "agent",
    )


def step_rule_agent(steps: DataFrame, policy: StepPolicy = StepPolicy()) -> DataFrame:
    return _step_log(_with_override(steps, RULE_AGENT, step_rule(policy), policy))


def composite_agent(
    steps: DataFrame, weights: CompositeWeights = CompositeWeights(), policy: StepPolicy = StepPolicy(),
) -> DataFrame:
    parts = steps.withColumns(composite_parts(weights))
    return _step_log(
        _with_override(parts, "composite", action_from_label(F.col("raw_label")), policy),
        "composite", "raw_label", "reasoning",
    )


def step_logs(
    steps: DataFrame, choices: Mapping[str, Column], policy: StepPolicy = StepPolicy(),
) -> DataFrame:
    """Logs of several agents over one pass of the steps."""
    per_agent = F.array(*[
        F.struct(F.lit(agent).alias("_agent"), action.alias("_choice")) for agent, action in choices.items()
    ])
    stacked = steps.select("*", F.inline(per_agent))
    return _step_log(_with_override(stacked, "", F.col("_choice"), policy).withColumn("agent", F.col("_agent")))


def model_step_agent(
    steps: DataFrame, probabilities: Callable[[Column], Column], policy: StepPolicy = StepPolicy(),
) -> DataFrame:
    """Step agent whose label comes from a text scorer over the rendered sentence."""
    scored = steps.withColumn("_text", step_text()).withColumn("_p", probabilities(F.col("_text"))).withColumns({
        "raw_label": dominant(F.col("_p.positive"), F.col("_p.neutral"), F.col("_p.negative")),
        "_confidence": F.greatest("_p.positive", "_p.neutral", "_p.negative"),
    }).withColumn("reasoning", F.format_string(
        "model: %s (conf=%.2f) | %s", "raw_label", F.bround("_confidence", 2), "_text",
    ))
    return _step_log(
        _with_override(scored, MODEL_AGENT, action_from_label(F.col("raw_label")), policy), "raw_label", "reasoning",
    )


def decide_bucketed(
    steps: DataFrame, decide: Callable[[Column, Column, Column], Column], policy: StepPolicy = StepPolicy(),
    text_col: str = "tweet_text", width: int = 5, max_chars: int | None = None,
) -> DataFrame:
    """Decide once per (text, rounded strength, rounded volatility) and reuse the answer.

    The earliest step of a bucket asks, with its own exact numbers, and every other step of the bucket gets
    its answer. The earliest step is found by a combining aggregate, staged with the bucket sizes; answers of
    very large buckets come back by broadcast.
    """
    text = strip(F.coalesce(F.col(text_col), F.lit("")))
    asked = F.col("_text") if max_chars is None else F.left("_text", F.lit(max_chars))  # cuts the question, not the key
    placed = steps.withColumns({
        "_text": text,
        "_rsi_bucket": bucketed(F.col("rsi_technical_indicator"), width),
        "_volatility_bucket": bucketed(F.col("volatility_index"), width),
    })
    bucket = F.concat_ws("|", F.md5("_text"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("_rsi_bucket", "_volatility_bucket")  # concat_ws skips nulls
    ])
    askers = placed.groupBy("_text", "_rsi_bucket", "_volatility_bucket").agg(
        F.min("step").alias("asked_at"), F.count(F.lit(1)).alias("_size"),
        F.min_by("rsi_technical_indicator", "step").alias("_rsi"),
        F.min_by("volatility_index", "step").alias("_volatility"),
    )
    answers = stage(askers.select(
        bucket.alias("_bucket"), "_size", "asked_at",
        decide(asked, F.col("_rsi"), F.col("_volatility")).alias("_answer"),
    ), "answers")
    keyed = placed.withColumn("_bucket", bucket).drop("_text", "_rsi_bucket", "_volatility_bucket")
    joined = lookup(keyed, answers, "_bucket", "_size", ["step"]).drop("_bucket")
    decided = _with_override(joined, MODEL_AGENT, F.col("_answer"), policy)
    return decided.withColumn("cached", F.col("asked_at") != F.col("step")).withColumn("reasoning", F.concat(
        F.format_string(
            "saw RSI=%.0f Vol=%.0f -> decided=%s", F.bround("rsi_technical_indicator", 0),
            F.bround("volatility_index", 0), "policy_action",
        ),
        F.when(F.col("cached"), " (cached)").otherwise(""),
        F.when(F.col("oracle_triggered"), F.format_string(
            " -> override (vol=%.1f>%.0f) -> HOLD", F.bround("volatility_index", 1), F.lit(policy.risk_volatility),
        )).otherwise(""),
    )).drop("_answer")


def policy_variants(windows: DataFrame, policies: Mapping[str, WindowPolicy]) -> DataFrame:
    """Decisions of several policies over the same windows, one row per (window, variant), without a rescan."""
    choices = F.array(*[
        F.struct(
            F.lit(name).alias("variant"),
            F.when(window_risk(p), "HOLD").otherwise(window_policy(p)).alias("action_taken"),
        ) for name, p in policies.items()
    ])
    return windows.select("dataset", "window_id", "cryptocurrency", F.inline(choices))
