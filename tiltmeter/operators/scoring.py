"""Scorers for post texts: native word lists, or any batch model behind an Arrow iterator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.config import NEGATIVE_WORDS, POSITIVE_WORDS, require_columns
from tiltmeter.functions.joins import lookup
from tiltmeter.functions.labels import sentiment_columns
from tiltmeter.functions.text import strip
from tiltmeter.schemas import SCORE_COLUMNS
from tiltmeter.session import stage
from tiltmeter.sources.score_store import ScoreStore

# Takes a list of texts, returns one (positive, neutral, negative) triple per text.
BatchScorer = Callable[[Sequence[str]], Sequence[Sequence[float]]]

_PROBABILITIES = "positive double, neutral double, negative double"


def lexicon_probabilities(
    text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """Class probabilities from word counts over the whole text, with one count reserved for neutral."""
    # One pass over the tokens finds the words of either list; the counts then look at those few.
    known = list(dict.fromkeys([*positive, *negative]))
    hits = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda t: t.isin(known))
    counts = F.transform(F.array(hits), lambda words: F.struct(
        F.size(F.filter(words, lambda t: t.isin(list(positive)))).alias("p"),
        F.size(F.filter(words, lambda t: t.isin(list(negative)))).alias("n"),
    ))
    return F.transform(counts, lambda c: F.struct(
        (c["p"] / (c["p"] + c["n"] + 1)).alias("positive"), (1 / (c["p"] + c["n"] + 1)).alias("neutral"),
        (c["n"] / (c["p"] + c["n"] + 1)).alias("negative"),
    ))[0]


def model_probabilities(text: Column, factory: Callable[[], BatchScorer], batch_size: int = 64) -> Column:
    """Class probabilities from a batch model.

    Only the text column crosses to Python, in Arrow batches; `factory` builds the model once per task.
    """

    @F.pandas_udf(_PROBABILITIES)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            texts = batch.fillna("").astype(str).tolist()
            triples = [t for i in range(0, len(texts), batch_size) for t in scorer(texts[i:i + batch_size])]
            yield pd.DataFrame(triples, columns=["positive", "neutral", "negative"], dtype="float64")

    return score(text)


def add_scores(df: DataFrame, probabilities: Callable[[Column], Column], text_col: str = "tweet_text") -> DataFrame:
    """Append the score columns to the same row, so nothing has to be matched by position."""
    require_columns(df.columns, [text_col])
    scored = df.withColumn("_p", probabilities(F.col(text_col)))
    return scored.withColumns(
        sentiment_columns(F.col("_p.positive"), F.col("_p.neutral"), F.col("_p.negative"))
    ).drop("_p")


def text_key(text_col: str) -> Column:
    """The whole text, trimmed; texts share a score only if all of it is equal."""
    return strip(F.coalesce(F.col(text_col), F.lit("")))


def score_distinct(
    df: DataFrame, probabilities: Callable[[Column], Column], text_col: str = "tweet_text",
    cache: DataFrame | None = None, max_chars: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score every distinct text once; returns the scored rows and the grown cache.

    The cache holds one row per text: digest, text, number of copies when it was scored, scores. Copies collapse
    map-side before the distinct texts are shuffled, and the scores come back by digest, hot texts by broadcast;
    which texts are hot depends on the rows of this call alone. `max_chars` cuts what the scorer reads, not the key.
    """
    columns = ["text_md5", "text", "copies", *SCORE_COLUMNS]
    keyed = df.withColumn("_text", text_key(text_col))
    fresh = (
        keyed.groupBy(F.col("_text").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("text_md5", F.md5("text"))
    )
    known = None
    if cache is not None:
        counts = stage(fresh, "texts")
        known = counts.join(cache.select("text_md5", *SCORE_COLUMNS), "text_md5").select(*columns)
        fresh = counts.join(cache.select("text_md5"), "text_md5", "left_anti")

    def limited(text: Column) -> Column:
        return probabilities(text if max_chars is None else F.left(text, F.lit(max_chars)))

    scored = stage(add_scores(fresh, limited, "text").select(*columns), "scores")
    grown, current = scored, scored
    if known is not None:
        grown, current = cache.select(*columns).unionByName(scored), stage(known.unionByName(scored).drop("text"), "scores")
    rows = keyed.withColumn("text_md5", F.md5("_text")).drop("_text")
    found = lookup(rows, current.drop("text"), "text_md5", "copies", df.columns)
    return found.drop("text_md5"), grown


def score_new(
    df: DataFrame, probabilities: Callable[[Column], Column], store: ScoreStore, text_col: str = "tweet_text", max_chars: int | None = None,
) -> DataFrame:
    """Score rows through a store that outlives the run: texts it holds are looked up, only new ones are scored and added.

    -> rows with the score columns and `score_batch`, the version of the store that brought the score. Distinct texts
    are grouped by digest, so a long text is no shuffle key; the lookup reads the store's folders of their prefixes only.
    """
    keyed = df.withColumn("text_md5", F.md5(text_key(text_col)))
    texts = stage(keyed.groupBy("text_md5").agg(F.first(text_key(text_col)).alias("text"), F.count(F.lit(1)).alias("copies")), "texts")
    prefixes = [row[0] for row in texts.select(store.prefix()).distinct().collect()]  # a few hundred at most
    since = store.latest()
    fresh = texts.join(store.read(since, prefixes).select("text_md5"), "text_md5", "left_anti")

    def limited(text: Column) -> Column:
        return probabilities(text if max_chars is None else F.left(text, F.lit(max_chars)))

    scored = stage(add_scores(fresh, limited, "text").select("text_md5", *SCORE_COLUMNS), "scores")
    if not scored.isEmpty():
        since = store.add(scored, since)
    known = store.read(since, prefixes).drop("prefix")
    current = stage(texts.select("text_md5", "copies").join(known, "text_md5"), "scores")
    return lookup(keyed, current, "text_md5", "copies", df.columns).drop("text_md5")
