"""Registered queries: every operator over the whole test tables, in a form both engines can hash.

Doubles are rounded to six places and times rendered as text; nothing else is changed about the results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.config import BASELINE, Experiment, NegativeCuts, WindowPolicy
from tiltmeter.functions import labels, text
from tiltmeter.functions.ordering import global_index
from tiltmeter.operators import cleaning, compare, decisions, injection, perturb, pnl, reports, scoring, steps, windows
from tiltmeter.plans.sweep import SweepTables, default_scorer, run_sweep, run_sweep_rows
from tiltmeter.session import stage, staging_path
from tiltmeter.operators.window_state import WindowStates
from tiltmeter.sources import demo, ingest, posts, registry, sinks
from tiltmeter.sources.score_store import ScoreStore
from tiltmeter.streaming.windows import decide_stream, decide_unique, start_decisions

Query = Callable[[SparkSession, str], DataFrame]

# Six hours hold 23 to 58 events each at the scale of the checks; five minutes would hold one.
EXPERIMENT = Experiment(freq="6 hours")
MAX_DELAY = "30 minutes"
WORDS = {"positive": ("ing", "ble", "the"), "negative": ("tion", "and", "les")}
SYMBOLS = {"src0": "BTC", "src1": "ETH", "fr": "ADA", "en": "DOGE"}
VARIANTS = {
    "standard": WindowPolicy(),
    "cautious": WindowPolicy(buy_above=0.08, sell_below=-0.05),
    "eager": WindowPolicy(buy_above=0.02, sell_below=0.0, risk_std=0.32),
    "no_override": WindowPolicy(risk_std=10.0),
}
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = shown(fn)
    return fn


def shown(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = fn(spark, folder)
        columns = []
        for field in df.schema.fields:
            col = F.col(f"`{field.name}`")
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                # The nudge moves values off exact halves, which the engines round differently.
                col = F.round(col + F.lit(1e-9), 6) + F.lit(0.0)
            elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
                col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            elif isinstance(field.dataType, T.ArrayType):
                col = F.array_join(col, "|")
            elif isinstance(field.dataType, T.MapType):
                entries = F.array_sort(F.map_entries(col))
                col = F.array_join(
                    F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|",
                )
            columns.append(col.alias(field.name))
        return df.select(*columns)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# Inputs ---------------------------------------------------------------------------------------------------


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return demo.scored_posts(spark, folder)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return demo.raw_posts(spark, folder)


def market(spark: SparkSession, folder: str) -> DataFrame:
    return demo.market_steps(spark, folder)


def sweep_tables(spark: SparkSession, folder: str) -> SweepTables:
    return run_sweep(scored(spark, folder), EXPERIMENT)


def baseline_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.window_features(scored(spark, folder), EXPERIMENT.freq)


def lean_answer() -> Column:
    """A stand-in for a model's reply, so that a second agent can be checked in SQL."""
    lean = F.col("positive_ratio") - F.col("negative_ratio")
    return (
        F.when(lean > 0.12, "Buy or sell? Answer: I would BUY.").when(lean <= 0.0, "Answer: sell now")
        .otherwise("Answer: wait")
    )


def both_agents(table: DataFrame) -> DataFrame:
    return decisions.rule_and_model(table, lean_answer())


def sweep_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return both_agents(sweep_tables(spark, folder).windows)


def variants(spark: SparkSession) -> DataFrame:
    return registry.dataset_registry(spark, EXPERIMENT.sweep)


def word_scorer(col: Column) -> Column:
    return scoring.lexicon_probabilities(col, WORDS["positive"], WORDS["negative"])


def labelled_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as labelled posts in time order."""
    # Positions first: placing rows reads them twice, so the costly scoring comes after.
    placed = global_index(
        raw(spark, folder).select(
            "index", F.try_to_timestamp("Date").alias("timestamp"), F.col("Content").alias("tweet_text"), "Hashtags",
        ), ["timestamp", "index"],
    )
    labelled = scoring.add_scores(placed, word_scorer)
    return labelled.select(
        "index", "timestamp", text.strip("tweet_text").alias("tweet_text"), F.col("finbert_label").alias("label"), "step",
        text.tag_symbol(text.parse_tags("Hashtags"), SYMBOLS, "CRYPTO").alias("cryptocurrency"),
    )


def with_text_digest(df: DataFrame) -> DataFrame:
    """The text as length and digest of the whole, to keep result tables readable."""
    return df.withColumns({"text_length": F.length("tweet_text"), "text_md5": F.md5("tweet_text")}).drop("tweet_text")


# Sources and sinks ----------------------------------------------------------------------------------------


@query
def read_posts_csv(spark, folder):
    path = staging_path(spark, "raw-csv")
    rows = raw(spark, folder)
    turned = F.crc32(F.col("index").cast("string")) % 2 == 1  # half of the posts go to files with the columns in another order
    sinks.write_csv(rows.where(~turned), f"{path}/a")
    sinks.write_csv(rows.where(turned).select(*reversed(rows.columns)), f"{path}/b")
    good, _ = posts.read_posts_csv(spark, [f"{path}/a", f"{path}/b"])
    return good.select("index", "Date", F.col("Content").alias("content"), "Hashtags", "Username", "URL")


def mixed_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw posts with three forms of time, some unreadable, some texts empty."""
    time = F.try_to_timestamp("Date")
    n = F.col("index").cast("long")
    form = (
        F.when(n % 23 == 7, "some day").when(n % 3 == 1, F.date_format(time, "dd/MM/yyyy HH:mm"))
        .when(n % 3 == 2, F.date_format(time, "MMM d, yyyy h:mm a")).otherwise(F.col("Date"))
    )
    return raw(spark, folder).withColumn("Date", form).withColumn("Content", F.when(n % 31 != 5, F.col("Content")).otherwise("  "))


@query
def ingest_posts(spark, folder):
    """Good and rejected rows of files with different columns, times and faults: every input row once."""
    path = staging_path(spark, "mixed-csv")
    rows = mixed_posts(spark, folder)
    long_ = F.col("index").cast("long") % 29 == 3
    sinks.write_csv(rows.where(~long_ & (F.col("index").cast("long") % 2 == 0)), f"{path}/a")
    sinks.write_csv(rows.where(~long_ & (F.col("index").cast("long") % 2 == 1)).select("Content", "Date", "index"), f"{path}/b")
    # Lines with a field too many, under a header of two.
    lines = spark.range(1).select(F.lit("Date,Content").alias("value"), F.lit(-1).alias("at")).unionAll(
        rows.where(long_).select(F.concat_ws(",", F.lit("2024-01-01 00:00:00"), "index", F.lit("more")), F.col("index").cast("int")),
    )
    sinks.write_text(lines.coalesce(1).sortWithinPartitions("at").select("value"), f"{path}/c")
    good, rejected = ingest.ingest_posts(spark, [f"{path}/a", f"{path}/b", f"{path}/c"])
    told = good.select("index", F.col("Date").alias("timestamp"), F.md5("Content").alias("text_md5"), F.lit(None).cast("string").alias("reason"))
    number = F.coalesce("index", F.split("_bad_row", ",")[1])
    return told.unionByName(rejected.select(number.alias("index"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("text_md5"), "reason"))


@query
def read_market_steps(spark, folder):
    """Typed market steps of two files with other column orders, two forms of time, ties and broken fields."""
    path = staging_path(spark, "market-csv")
    rows = market(spark, folder).withColumnRenamed("step", "event_id")
    n = F.col("event_id")
    loose = rows.withColumns({
        "rsi_technical_indicator": F.when(n % 37 == 5, "n/a").when(n % 37 == 6, "").otherwise(F.col("rsi_technical_indicator").cast("string")),
        "volatility_index": F.when(n % 43 == 11, "NaN").otherwise(F.col("volatility_index").cast("string")),
        "timestamp": F.when(n % 41 == 7, "soon").when(n % 2 == 1, F.date_format(F.date_trunc("minute", "timestamp"), "dd/MM/yyyy HH:mm"))
        .otherwise(F.date_format(F.date_trunc("minute", "timestamp"), "yyyy-MM-dd HH:mm:ss")),
    })
    sinks.write_csv(loose.where(n % 3 > 0), f"{path}/a")
    sinks.write_csv(loose.where(n % 3 == 0).select(*reversed(loose.columns)), f"{path}/b")
    order = T.StructType([T.StructField("event_id", T.LongType())])
    steps_, rejected = ingest.read_market_steps(spark, [f"{path}/a", f"{path}/b"], order)
    told = steps_.select("event_id", "step", "timestamp", "rsi_technical_indicator", "volatility_index", F.lit(None).cast("string").alias("reason"))
    lost = rejected.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "reason")
    return told.unionByName(lost, allowMissingColumns=True)


@query
def normalize_scored(spark, folder):
    loose = scored(spark, folder).select(
        "tweet_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "cryptocurrency",
        F.when(F.col("tweet_id").endswith("7"), "n/a").otherwise(F.col("sentiment_score").cast("string"))
        .alias("sentiment_score"),
        F.col("sentiment_confidence").alias("p_positive"), F.lit(None).cast("boolean").alias("is_synthetic"),
    )
    return posts.normalize_scored(loose)


@query
def scored_cache(spark, folder):
    path = staging_path(spark, "scored")
    sinks.cached_table(spark, path, lambda: scored(spark, folder))
    return sinks.cached_table(spark, path, lambda: scored(spark, folder).limit(0))


@query
def finalize_dataset(spark, folder):
    rows = perturb.amplify(scored(spark, folder), 1.5).drop("mutation_type")
    path = staging_path(spark, "datasets")
    sinks.save_datasets(rows.withColumns({
        "dataset": F.lit("sentiment_1.5"), "mutation_type": F.lit(None).cast("string"),
    }), path)
    return spark.read.parquet(path).drop("sweep_strength", "sweep_family")


@query
def csv_sink(spark, folder):
    path = staging_path(spark, "adr-csv")
    table = compare.sweep_adr(sweep_decisions(spark, folder), variants(spark))
    sinks.write_csv(table, path)
    return spark.read.options(header=True, quote='"', escape='"').schema(table.schema).csv(path).fillna({"top_flips": ""})


@query
def csv_lists(spark, folder):
    """Lists through the CSV sink, as JSON text."""
    path = staging_path(spark, "lists-csv")
    table = raw(spark, folder).select("index", text.parse_tags("Hashtags").alias("tags"))
    sinks.write_csv(table, path)
    return spark.read.options(header=True, quote='"', escape='"').csv(path)


@query
def json_sink(spark, folder):
    path = staging_path(spark, "trajectory-json")
    table = decisions.rule_agent(baseline_windows(spark, folder))
    sinks.write_json(table, path)
    return spark.read.schema(table.schema).json(path)


@query
def text_report(spark, folder):
    path = staging_path(spark, "report")
    base = market(spark, folder)
    report = steps.drift_steps(
        decisions.step_rule_agent(base), decisions.step_rule_agent(perturb.amplify_steps(base, 2.0)),
    )
    sinks.write_text(reports.drift_text(report), path)
    return spark.read.text(path)


@query
def dataset_registry(spark, folder):
    """Registry entries with the number of windows each dataset really has."""
    counts = sweep_tables(spark, folder).windows.groupBy("dataset").agg(F.count(F.lit(1)).alias("windows"))
    return variants(spark).join(counts, "dataset")


@query
def main_aliases(spark, folder):
    """The alias views of the main datasets, as row counts."""
    views = registry.main_views(sweep_tables(spark, folder).windows, variants(spark))
    parts = [spark.table(v).agg(F.lit(v).alias("view"), F.sum("tweet_count").alias("posts")) for v in views]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


@query
def dataset_qa(spark, folder):
    return registry.dataset_qa(run_sweep_rows(scored(spark, folder), EXPERIMENT), variants(spark))


@query
def qa_violations(spark, folder):
    return registry.qa_violations(
        registry.dataset_qa(run_sweep_rows(scored(spark, folder), EXPERIMENT), variants(spark))
    )


# Cleaning and text ----------------------------------------------------------------------------------------


@query
def normalize_text(spark, folder):
    return demo.table(spark, folder, "documents").select("doc_id", text.normalize_text("text").alias("text"))


@query
def parse_tags(spark, folder):
    forms = demo.table(spark, folder, "documents").select("doc_id", F.expr("""
        CASE doc_id % 6 WHEN 0 THEN concat("['", source, "', '", lang, "']") WHEN 1 THEN concat(source, ' , ', lang, ',')
        WHEN 2 THEN concat('"', source, '"') WHEN 3 THEN '' WHEN 4 THEN concat('(" ', source, '", 12,)') END
    """).alias("field"))
    tags = text.parse_tags("field")
    return forms.select("doc_id", tags.alias("tags"), F.size(tags).alias("n_tags"))


@query
def detect_topics(spark, folder):
    found = text.detect_topics(text.parse_tags("Hashtags"), text.normalize_text("Content"), demo.DEMO_TOPICS)
    return raw(spark, folder).select("index", found.alias("topics"))


@query
def tag_symbol(spark, folder):
    return raw(spark, folder).select(
        "index", text.tag_symbol(text.parse_tags("Hashtags"), SYMBOLS, "CRYPTO").alias("symbol"),
    )


@query
def explode_topics(spark, folder):
    ready = cleaning.prepare_posts(raw(spark, folder))
    one_each = cleaning.explode_topics(ready, demo.DEMO_TOPICS)
    joined = cleaning.explode_topics(ready, demo.DEMO_TOPICS, explode_multi_topic=False)
    columns = ["source_row_id", "cryptocurrency", "tweet_id"]
    return one_each.select(*columns, F.lit("each").alias("mode")).unionByName(
        joined.select(*columns, F.lit("joined").alias("mode"))
    )


@query
def clean_posts(spark, folder):
    return with_text_digest(cleaning.clean_posts(raw(spark, folder), demo.DEMO_TOPICS))


@query
def dedup_posts(spark, folder):
    """First post of every text, by document number."""
    documents = demo.table(spark, folder, "documents").withColumn("text_md5", F.md5("text"))
    return cleaning.keep_first(documents.select("doc_id", "text_md5", "lang"), ["text_md5"], ["doc_id"])


@query
def label_from_score(spark, folder):
    return scored(spark, folder).select(
        "tweet_id", labels.label_from_score(F.col("sentiment_score")).alias("label"),
    )


@query
def parse_answer(spark, folder):
    replies = demo.table(spark, folder, "events").select("event_id", F.expr("""
        CASE event_id % 6 WHEN 0 THEN concat('Answer: BUY on ', event_type) WHEN 1 THEN 'buy? Answer: better SELL, not hold'
        WHEN 2 THEN concat('Sell ', event_type) WHEN 3 THEN concat('Answer: ', event_type) WHEN 4 THEN 'Hold, it is positive'
        END
    """).alias("reply"))
    return replies.select(
        "event_id", text.answer_action("reply").alias("action"), text.answer_sentiment("reply").alias("sentiment"),
    )


@query
def render_window_text(spark, folder):
    return baseline_windows(spark, folder).select("window_id", decisions.window_text().alias("text"))


@query
def render_step_text(spark, folder):
    return market(spark, folder).select("step", decisions.step_text().alias("text"))


# Scoring --------------------------------------------------------------------------------------------------


@query
def probs_to_sentiment(spark, folder):
    p = demo.table(spark, folder, "events").select(
        "event_id", (F.col("event_id") % 5 / 10.0).alias("p"), (F.col("user_id") % 5 / 10.0).alias("n"),
    )
    return p.select("event_id", *[
        c.alias(name) for name, c in labels.sentiment_columns(
            F.col("p").cast("double"), (F.lit(1.0) - F.col("p") - F.col("n")).cast("double"), F.col("n").cast("double"),
        ).items()
    ])


@query
def score_lexicon(spark, folder):
    documents = demo.table(spark, folder, "documents").select("doc_id", "text")
    return scoring.add_scores(documents, word_scorer, "text").drop("text")


class WordModel:
    """Counts words in Python; stands for a model that only exists as a batch function."""

    def __init__(self, positive: tuple[str, ...], negative: tuple[str, ...]):
        self.positive, self.negative = frozenset(positive), frozenset(negative)

    def __call__(self, texts):
        import re

        for body in texts:
            tokens = re.split("[^a-z]+", body.lower())
            p = sum(t in self.positive for t in tokens)
            n = sum(t in self.negative for t in tokens)
            yield p / (p + n + 1), 1 / (p + n + 1), n / (p + n + 1)


@query
def score_udf(spark, folder):
    documents = demo.table(spark, folder, "documents").select("doc_id", "text")
    positive, negative = WORDS["positive"], WORDS["negative"]

    def model(col: Column) -> Column:
        return scoring.model_probabilities(col, lambda: WordModel(positive, negative))

    return scoring.add_scores(documents, model, "text").drop("text")


@query
def score_distinct(spark, folder):
    """Scores through a cache that already knows the English documents."""
    documents = demo.table(spark, folder, "documents").select("doc_id", "text", "lang")
    _, cache = scoring.score_distinct(documents.where("lang = 'en'"), word_scorer, "text")
    rows, _ = scoring.score_distinct(documents, word_scorer, "text", cache=cache)
    return rows.drop("text")


@query
def score_store(spark, folder):
    """Two runs over one kept store: the second scores only texts that the first did not meet."""
    documents = demo.table(spark, folder, "documents").select("doc_id", "text", "lang")
    store = ScoreStore(spark, staging_path(spark, "score-store"), digits=1)
    scoring.score_new(documents.where("lang = 'en'"), word_scorer, store, "text")
    scoring.score_new(documents, word_scorer, store, "text")
    store.compact()
    return scoring.score_new(documents, word_scorer, store, "text").drop("text")


@query
def score_truncated(spark, folder):
    """Scores of the first 40 characters of every text; equal beginnings of different texts do not share a score."""
    documents = demo.table(spark, folder, "documents").select("doc_id", "text")
    rows, _ = scoring.score_distinct(documents, word_scorer, "text", max_chars=40)
    return rows.drop("text")


@query
def heuristic_policy(spark, folder):
    return decisions.composite_agent(market(spark, folder))


@query
def decide_bucketed(spark, folder):
    fed = demo.table(spark, folder, "events").selectExpr(*demo.MARKET_STEPS, "event_type AS tweet_text")

    def decide(body: Column, rsi: Column, volatility: Column) -> Column:
        return (
            F.when(body.isin("click", "view") & (rsi < 48), "BUY").when(rsi + volatility > 121, "SELL").otherwise("HOLD")
        )

    return decisions.decide_bucketed(fed, decide).select(
        "step", "policy_action", "action_taken", "oracle_triggered", "asked_at", "cached", "reasoning",
    )


def reply_model() -> decisions.Answer:
    """A deterministic reply to a window question."""
    def reply(questions):
        import re

        for question in questions:
            found = re.search(r"positive=(\d+)%, neutral=\d+%, negative=(\d+)%", question)
            gap = int(found[1]) - int(found[2])
            yield "I would buy" if gap > 12 else "Answer: SELL" if gap < 0 else "no clear signal"

    return reply


@query
def model_agent(spark, folder):
    return decisions.model_agent(baseline_windows(spark, folder), reply_model)


# Perturbations --------------------------------------------------------------------------------------------


@query
def amplify(spark, folder):
    return perturb.amplify(scored(spark, folder), 1.5)


@query
def time_jitter(spark, folder):
    return perturb.time_jitter(scored(spark, folder), 15)


@query
def row_lag(spark, folder):
    return perturb.row_lag(market(spark, folder), 3).select("step", "news_impact_score")


@query
def market_frame(spark, folder):
    return with_text_digest(perturb.market_frame(labelled_posts(spark, folder)).drop("label", "index"))


@query
def emphasize(spark, folder):
    louder = perturb.emphasize(perturb.market_frame(labelled_posts(spark, folder)), 0.5)
    return with_text_digest(louder.drop("label", "index"))


@query
def text_lag(spark, folder):
    late = perturb.row_lag(perturb.market_frame(labelled_posts(spark, folder)), 3, text="tweet_text")
    return with_text_digest(late.select("step", "tweet_text", "news_impact_score"))


@query
def select_targets(spark, folder):
    return injection.select_targets(baseline_windows(spark, folder)).select(
        "window_id", "cryptocurrency", "tweet_count", "mean_sentiment_score", "abs_mean_sentiment_score",
        "adversarial_direction",
    )


@query
def injection_plan(spark, folder):
    plan = injection.injection_plan(injection.select_targets(baseline_windows(spark, folder)))
    return plan.select(
        "dataset", "window_id", "adversarial_direction", "nominal_injection_ratio", "original_tweet_count",
        "synthetic_count", "actual_injection_ratio", "cap_hit",
    )


def synthetic_posts(spark: SparkSession, folder: str) -> DataFrame:
    plan = injection.injection_plan(injection.select_targets(baseline_windows(spark, folder)))
    return injection.inject_posts(plan)


@query
def inject_posts(spark, folder):
    return synthetic_posts(spark, folder).drop("source_row_id")


@query
def injected_dataset(spark, folder):
    rows = injection.injected_dataset(
        scored(spark, folder), synthetic_posts(spark, folder), 0.20, default_scorer(EXPERIMENT),
    )
    return rows.select(
        "tweet_id", "timestamp", "cryptocurrency", "finbert_label", "sentiment_score", "is_synthetic", "mutation_type",
        "adversarial_direction", "target_window_id", "sweep_family", "sweep_strength",
    )


@query
def sweep(spark, folder):
    return run_sweep_rows(scored(spark, folder), EXPERIMENT).select(
        "dataset", "tweet_id", "timestamp", "cryptocurrency", "finbert_label", "sentiment_score",
        "sentiment_confidence", "is_synthetic", "mutation_type", "sweep_family", "sweep_strength",
    )


# Windows --------------------------------------------------------------------------------------------------


@query
def window_features(spark, folder):
    return baseline_windows(spark, folder)


@query
def kept_windows(spark, folder):
    """Windows from kept states of three loads, compacted after the second: as if loaded at once."""
    posts_ = scored(spark, folder)
    kept = WindowStates(spark, staging_path(spark, "window-states"), EXPERIMENT.freq)
    part = F.crc32(F.col("tweet_id")) % 3
    for load in range(3):
        kept.add(posts_.where(part == load))
        if load == 1:
            kept.compact()
    return kept.windows().drop("dataset")


@query
def sweep_windows(spark, folder):
    return sweep_tables(spark, folder).windows


@query
def regimes(spark, folder):
    return sweep_tables(spark, folder).windows.select("dataset", "window_id", "dominant_label", "regime")


@query
def regime_counts(spark, folder):
    return windows.regime_counts(baseline_windows(spark, folder))


@query
def busiest_windows(spark, folder):
    return windows.busiest_windows(baseline_windows(spark, folder)).select("window_id", "tweet_count", "regime")


@query
def value_counts(spark, folder):
    return windows.value_counts(scored(spark, folder), "cryptocurrency", "finbert_label")


@query
def load_summary(spark, folder):
    return windows.load_summary(sweep_tables(spark, folder).windows)


@query
def negative_summary(spark, folder):
    return windows.negative_summary(stage(sweep_tables(spark, folder).windows, "sweep-windows"))


@query
def negative_thresholds(spark, folder):
    return windows.negative_thresholds(sweep_tables(spark, folder).windows, NegativeCuts())


@query
def most_negative(spark, folder):
    return windows.most_negative(sweep_tables(spark, folder).windows)


# Decisions ------------------------------------------------------------------------------------------------


@query
def window_policy(spark, folder):
    return sweep_tables(spark, folder).windows.select(
        "dataset", "window_id", decisions.window_policy().alias("policy_action"),
        decisions.window_risk().alias("oracle_triggered"),
    )


@query
def trajectory(spark, folder):
    return decisions.rule_agent(sweep_tables(spark, folder).windows)


@query
def step_policy(spark, folder):
    return decisions.step_rule_agent(market(spark, folder))


@query
def model_step_policy(spark, folder):
    """Step agent whose label comes from scoring the rendered sentence."""
    def scorer(col: Column) -> Column:
        return scoring.lexicon_probabilities(col, ("up", "positive", "oversold"), ("down", "negative", "overbought"))

    return decisions.model_step_agent(market(spark, folder), scorer).select(
        "step", "raw_label", "reasoning", "policy_action", "action_taken", "oracle_triggered",
    )


# Comparisons ----------------------------------------------------------------------------------------------


@query
def adr(spark, folder):
    return compare.adr(sweep_decisions(spark, folder), count_unmatched=True)


@query
def transitions(spark, folder):
    pairs = compare.matched(sweep_decisions(spark, folder))
    return compare.transitions(pairs, ["agent", "dataset"], "action_base", "action_taken")


@query
def transition_maps(spark, folder):
    pairs = compare.matched(sweep_decisions(spark, folder))
    keys = ["agent", "dataset"]
    return compare.transition_map(compare.transitions(pairs, keys, "action_base", "action_taken"), keys)


@query
def top_flips(spark, folder):
    return compare.top_flips(sweep_decisions(spark, folder))


@query
def sweep_adr(spark, folder):
    return compare.sweep_adr(sweep_decisions(spark, folder), variants(spark))


@query
def main_adr(spark, folder):
    return compare.main_only(compare.sweep_adr(sweep_decisions(spark, folder), variants(spark)))


@query
def consensus(spark, folder):
    return compare.consensus(sweep_decisions(spark, folder), variants(spark))


@query
def main_consensus(spark, folder):
    return compare.main_only(compare.consensus(sweep_decisions(spark, folder), variants(spark)))


@query
def agreement_matrix(spark, folder):
    return compare.agreement_matrix(sweep_decisions(spark, folder))


@query
def action_distribution(spark, folder):
    return compare.action_distribution(sweep_decisions(spark, folder), variants(spark))


@query
def variant_counts(spark, folder):
    return compare.variant_counts(decisions.policy_variants(sweep_tables(spark, folder).windows, VARIANTS))


@query
def variant_summary(spark, folder):
    return compare.variant_summary(decisions.policy_variants(sweep_tables(spark, folder).windows, VARIANTS))


@query
def injection_flips(spark, folder):
    return compare.injection_flips(sweep_decisions(spark, folder), variants(spark))


@query
def flip_classes(spark, folder):
    return compare.flip_classes(sweep_decisions(spark, folder), variants(spark))


@query
def injection_ratio(spark, folder):
    return compare.injection_ratio(sweep_tables(spark, folder).windows, variants(spark))


@query
def injection_ratio_summary(spark, folder):
    return compare.injection_ratio_summary(compare.injection_ratio(sweep_tables(spark, folder).windows, variants(spark)))


@query
def sensitivity(spark, folder):
    return compare.sensitivity(compare.sweep_adr(sweep_decisions(spark, folder), variants(spark)), "ADR_%", "agent")


@query
def consensus_sensitivity(spark, folder):
    return compare.sensitivity(compare.consensus(sweep_decisions(spark, folder), variants(spark)), "consensus_%")


@query
def timeline(spark, folder):
    return compare.timeline(sweep_decisions(spark, folder))


@query
def agreement_share(spark, folder):
    return compare.agreement_share(compare.timeline(sweep_decisions(spark, folder)))


# Steps ----------------------------------------------------------------------------------------------------


def experiments(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    base = market(spark, folder)
    return {
        BASELINE: decisions.step_rule_agent(base),
        "intensity": decisions.step_rule_agent(perturb.amplify_steps(base, 2.0)),
        "lag": decisions.step_rule_agent(perturb.row_lag(base, 3)),
    }


def stacked(logs: dict[str, DataFrame]) -> DataFrame:
    parts = [log.withColumn("experiment", F.lit(name)) for name, log in logs.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table


@query
def drift_steps(spark, folder):
    """Both experiments against the baseline, from one stacked log."""
    return steps.drift_all(stacked(experiments(spark, folder)), BASELINE, ["intensity", "lag"])


@query
def drift_sentiment_lag(spark, folder):
    """A delay of the sentiment that the agent decides on, beside one of the news that it does not read."""
    base = market(spark, folder)
    late = {"sentiment_lag": "social_sentiment_score", "lag": "news_impact_score"}
    logs = {name: decisions.step_rule_agent(perturb.row_lag(base, 3, numeric=column)) for name, column in late.items()}
    return steps.drift_all(stacked({BASELINE: decisions.step_rule_agent(base), **logs}), BASELINE, list(late))


@query
def drift_pair(spark, folder):
    logs = experiments(spark, folder)
    return steps.drift_steps(logs[BASELINE], logs["intensity"])


@query
def consensus_steps(spark, folder):
    louder = perturb.amplify_steps(market(spark, folder), 2.0)
    return steps.consensus_steps(decisions.step_rule_agent(louder), decisions.composite_agent(louder))


@query
def compare_steps(spark, folder):
    return steps.compare_steps(
        stacked(experiments(spark, folder)), [3, 10, 50], [BASELINE, "intensity", "lag"],
    )


@query
def show_decisions(spark, folder):
    return steps.show_decisions(decisions.step_rule_agent(market(spark, folder)), 5, "BUY")


@query
def first_active(spark, folder):
    return steps.first_active(decisions.composite_agent(market(spark, folder)))


@query
def combined_log(spark, folder):
    louder = perturb.amplify_steps(market(spark, folder), 2.0)
    return steps.combined_log(
        pnl.with_pnl(decisions.step_rule_agent(louder)), pnl.with_pnl(decisions.composite_agent(louder)),
    ).select(
        "step", "rule_action_taken", "agent_action_taken", "agent_raw_label", "pnl_rule", "pnl_agent", "actions_agree",
    )


@query
def step_index(spark, folder):
    return posts.load_steps(market(spark, folder).withColumnRenamed("step", "event_id"), "event_id").select(
        "event_id", "step", "timestamp",
    )


@query
def pnl_steps(spark, folder):
    loaded = posts.load_steps(market(spark, folder).withColumnRenamed("step", "event_id"), "event_id")
    logs = decisions.step_logs(loaded, {
        "deterministic": decisions.step_rule(),
        "composite": labels.action_from_label(decisions.composite_parts()["raw_label"]),
    })
    return pnl.with_running_pnl(logs, ["agent"]).select("agent", "step", "action_taken", "pnl", "cum_pnl")


def step_totals(spark: SparkSession, folder: str) -> DataFrame:
    return pnl.pnl_summary(pnl.with_pnl(stacked(experiments(spark, folder))), "experiment")


@query
def pnl_summary(spark, folder):
    return step_totals(spark, folder)


@query
def pnl_compare(spark, folder):
    totals = step_totals(spark, folder).withColumnRenamed("experiment", "series")
    return pnl.pnl_compare(pnl.pair_totals(totals, "series", [
        ("intensity", BASELINE, "intensity"), ("lag", BASELINE, "lag"),
    ]))


@query
def pnl_report(spark, folder):
    totals = step_totals(spark, folder).withColumnRenamed("experiment", "series")
    table = pnl.pnl_compare(pnl.pair_totals(totals, "series", [
        ("intensity", BASELINE, "intensity"), ("lag", BASELINE, "lag"),
    ]))
    return reports.pnl_table_text(table, "Baseline", "Mutant").unionByName(reports.pnl_line(totals, "series"))


# Streaming ------------------------------------------------------------------------------------------------


@query
def stream_windows(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    arriving = events.selectExpr(*demo.SCORED_POSTS).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = staging_path(spark, "stream-decisions")
    decided = decide_stream(arriving, EXPERIMENT.freq, MAX_DELAY)
    start_decisions(decided, path, staging_path(spark, "stream-state"), once=True).awaitTermination()
    return spark.read.parquet(path)


@query
def stream_unique(spark, folder):
    """The stream with every third post delivered twice: the same decisions."""
    source = staging_path(spark, "stream-source")
    events = demo.table(spark, folder, "events").selectExpr(*demo.SCORED_POSTS).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    again = events.where(F.crc32(F.col("tweet_id")) % 3 == 0)
    events.unionByName(again).write.parquet(source)
    arriving = spark.readStream.schema(events.schema).parquet(source)
    path = staging_path(spark, "unique-decisions")
    decided = decide_unique(arriving, EXPERIMENT.freq, MAX_DELAY)
    start_decisions(decided, path, staging_path(spark, "unique-state"), once=True).awaitTermination()
    return spark.read.parquet(path)
