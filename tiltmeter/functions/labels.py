"""Labels, scores and actions derived from one another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dominant(positive: Column, neutral: Column, negative: Column) -> Column:
    """Label of the largest value; ties go to positive, then neutral."""
    top = F.greatest(positive, neutral, negative)
    return F.when(positive == top, "positive").when(neutral == top, "neutral").otherwise("negative")


def sentiment_columns(positive: Column, neutral: Column, negative: Column) -> dict[str, Column]:
    """The six score columns from three class probabilities."""
    p, u, n = (c.cast("double") for c in (positive, neutral, negative))
    return {
        "finbert_label": dominant(p, u, n),
        "finbert_positive": p,
        "finbert_neutral": u,
        "finbert_negative": n,
        "sentiment_score": p - n,
        "sentiment_confidence": F.greatest(p, u, n),
    }


def label_from_score(score: Column, edge: float = 0.05) -> Column:
    return F.when(score > edge, "positive").when(score < -edge, "negative").otherwise("neutral")


def score_from_label(label: Column) -> Column:
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def action_from_label(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low == "positive", "BUY").when(low == "negative", "SELL").otherwise("HOLD")


def direction(action: Column) -> Column:
    """+1, -1 or 0 for BUY, SELL or HOLD."""
    return F.when(action == "BUY", 1).when(action == "SELL", -1).when(action == "HOLD", 0)


def action_of(sign: Column) -> Column:
    """Inverse of `direction`."""
    return F.when(sign == 1, "BUY").when(sign == -1, "SELL").when(sign == 0, "HOLD")
