"""Declared schemas of the tables that enter or leave the engine. The column names are fixed values: results must carry them."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


S, B, L, D, TS = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.TimestampType()

RAW_POST = _struct(index=S, Date=S, Content=S, Hashtags=S, URL=S, Username=S)

CLEAN_POST = _struct(
    tweet_id=S, source_row_id=S, timestamp=TS, cryptocurrency=S, tweet_text=S, hashtags=T.ArrayType(S), url=S,
    username=S, is_synthetic=B, mutation_type=S, adversarial_direction=S, target_window_id=S, source=S,
)

SCORE_COLUMNS = (
    "finbert_label", "finbert_positive", "finbert_neutral", "finbert_negative", "sentiment_score",
    "sentiment_confidence",
)

SCORES = _struct(
    finbert_label=S, finbert_positive=D, finbert_neutral=D, finbert_negative=D, sentiment_score=D,
    sentiment_confidence=D,
)

SCORED_POST = T.StructType(CLEAN_POST.fields + SCORES.fields)

WINDOW = _struct(
    window_id=S, window_start=TS, window_end=TS, cryptocurrency=S, tweet_count=L, synthetic_count=L,
    positive_count=L, neutral_count=L, negative_count=L, positive_ratio=D, neutral_ratio=D, negative_ratio=D,
    mean_sentiment_score=D, sentiment_std=D, sentiment_intensity=D, mean_sentiment_confidence=D,
    dominant_label=S, regime=S,
)

TRAJECTORY = _struct(
    window_id=S, window_start=S, cryptocurrency=S, tweet_count=L, mean_sentiment=D, sentiment_std=D,
    positive_ratio=D, negative_ratio=D, synthetic_count=L, policy_action=S, action_taken=S, oracle_triggered=B,
    agent=S, dataset=S,
)

MARKET_STEP = _struct(
    timestamp=TS, cryptocurrency=S, social_sentiment_score=D, news_impact_score=D, rsi_technical_indicator=D,
    volatility_index=D, fear_greed_index=D, current_price_usd=D, price_change_24h_percent=D,
)

# Column order of a saved dataset; other columns follow in their own order.
DATASET_ORDER = (
    "tweet_id", "timestamp", "cryptocurrency", "text", "tweet_text", "finbert_label", "finbert_positive",
    "finbert_neutral", "finbert_negative", "sentiment_score", "sentiment_confidence", "mutation_type",
    "is_synthetic", "adversarial_direction", "target_window_id", "source",
)
