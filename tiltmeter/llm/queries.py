"""The registered queries of the operators, with the parameters of production, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(of: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def byte_bpe_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.secret_scan import scan

    def listed(spans: str) -> F.Column:
        return F.array_join(F.expr(f"transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop))"), ",")

    found = scan(read(spark, sf_dir, "documents"))
    count = {kind: F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "random")}
    base = F.sha2(listed("filter(secret_spans, s -> s.kind <> 'random')"), 256)
    return found.select("doc_id", count["assign"], count["access"], count["hex"], base.alias("base_sha256"), listed("secret_spans").alias("spans"), count["random"])


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.quality_rules import judge

    judged = judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.quality_classifier import classify

    scored = classify(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.html_text import extract

    found = extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.toxicity import score_texts

    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    scored = score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.embedding_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.source_mixing import mix

    mixed = mix(read(spark, sf_dir, "documents"))
    shards = F.expr("transform(draws, d -> d.shard)")
    return mixed.select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), shards.alias("shards"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.language_model import score_texts

    part = F.when(remainder(7) == 2, 2).when(remainder(7) == 6, 1).otherwise(0)
    return score_texts(read(spark, sf_dir, "documents"), part)


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.byte_bpe import round_trip

    coded = round_trip(read(spark, sf_dir, "documents"), *byte_bpe_ranks())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.line_dedup import dedup_lines

    kept = dedup_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.collocations import collocations

    return collocations(read(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tiltmeter.llm.merkle import verified

    tampered = F.coalesce(remainder(7) == 0, F.lit(False))
    return verified(read(spark, sf_dir, "documents"), {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan,
    "op2_quality_rules": quality_rules,
    "op3_language_model": language_model,
    "op4_jaccard_join": jaccard,
    "op5_quality_classifier": quality_classifier,
    "op6_html_text": html_text,
    "op7_toxicity": toxicity,
    "op8_embedding_dedup": embedding_dedup,
    "op9_source_mixing": source_mixing,
    "op10_byte_bpe": byte_bpe,
    "op11_line_dedup": line_dedup,
    "op12_collocations": phrases,
    "op13_merkle_manifest": merkle_manifest,
}
