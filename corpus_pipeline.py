"""A training-data pipeline over `documents`: quality, near duplicates, secrets, source mix, tokens.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its result is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents, and read no others, so further
columns of the input (also such as clash with a stage's own names) are dropped by the first stage. Null and empty texts
have no quality and go in the first stage. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm.byte_bpe import encode
from tiltmeter.llm.jaccard_join import BROADCAST_IDS, jaccard_components
from tiltmeter.llm.quality_classifier import classify
from tiltmeter.llm.queries import byte_bpe_ranks
from tiltmeter.llm.secret_scan import redacted, scan
from tiltmeter.llm.source_mixing import arranged, mix
from tiltmeter.session import stage, staging_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps."""
    return classify(docs.select(*COLUMNS), keep=COLUMNS).where("quality_kept").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Rows are told apart, not ids: these may repeat or be null."""
    rows = _numbered(docs.select(*COLUMNS))
    groups = jaccard_components(rows.select("row", "text"), id_col="row")
    away = stage(groups.where("row <> component_id").select("row"), "away")
    return rows.join(_small(away), "row", "left_anti").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number of its own for every row: the id, or one below all ids where an id is null or repeated."""
    again = stage(docs.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("again is null or n > 1").select("again"), "repeated")
    if again.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    low = docs.agg(F.min("doc_id")).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    more = docs.join(_small(again), same, "left_semi").withColumn("row", F.lit(low - 1).cast("long") - F.monotonically_increasing_id())
    return docs.join(_small(again), same, "left_anti").withColumn("row", F.col("doc_id")).unionByName(stage(more, "numbered"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mark."""
    found = scan(docs.select(*COLUMNS), keep=COLUMNS)
    return found.withColumn("text", redacted(F.col("text"), F.col("secret_spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix draws, in the order of its shards."""
    return arranged(mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every drawn copy."""
    return encode(docs.select(*COLUMNS), *byte_bpe_ranks()).select("doc_id", "n_tokens", "ids")


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_IDS ids, shuffle beyond."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("source mixing", source_mix),
    ("byte-level BPE", tokens),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = staging_path(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
