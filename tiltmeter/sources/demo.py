"""Views of the generic test tables in the shapes the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCORED_POSTS = [
    "CAST(event_id AS STRING) AS tweet_id",
    "ts AS timestamp",
    "CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS cryptocurrency",
    "(least(value, 100.0D) - 41.0D) / 200.0D AS sentiment_score",
    "CASE WHEN value > 81 THEN 'positive' WHEN value < 5 THEN 'negative' ELSE 'neutral' END AS finbert_label",
    "CAST(50 + event_id % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS sentiment_confidence",
    "false AS is_synthetic",
]

MARKET_STEPS = [
    "event_id AS step",
    "ts AS timestamp",
    "CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS cryptocurrency",
    "greatest(-1.0D, least(1.0D, (value - 50.0D) / 50.0D)) AS social_sentiment_score",
    "CAST((event_id * 13) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS news_impact_score",
    "CAST((event_id * 37) % 101 AS DOUBLE) AS rsi_technical_indicator",
    "CAST((event_id * 53) % 101 AS DOUBLE) AS volatility_index",
    "CAST((event_id * 29) % 101 AS DOUBLE) AS fear_greed_index",
    "CAST((event_id * 17) % 41 - 20 AS DOUBLE) / CAST(2 AS DOUBLE) AS price_change_24h_percent",
    "CAST(100.0 AS DOUBLE) AS current_price_usd",
]

RAW_POSTS = [
    "CAST(doc_id AS STRING) AS `index`",
    "concat('2024-01-01 ', lpad(CAST(doc_id % 24 AS STRING), 2, '0'), ':',"
    " lpad(CAST(doc_id % 60 AS STRING), 2, '0'), ':00') AS `Date`",
    "text AS `Content`",
    "concat('[''', source, ''', ''', lang, ''']') AS `Hashtags`",
    "concat('user', CAST(doc_id % 7 AS STRING)) AS `Username`",
    "CAST(NULL AS STRING) AS `URL`",
]

# Topics that occur in the test documents.
DEMO_TOPICS = {"BTC": ("ble", "src0"), "ETH": ("ing", "src1")}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored_posts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*SCORED_POSTS)


def market_steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*MARKET_STEPS)


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(*RAW_POSTS)
