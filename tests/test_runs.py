import glob

import pytest
from pyspark.sql import functions as F

from tiltmeter import session
from tiltmeter.config import BASELINE, Experiment, TargetRules
from tiltmeter.operators import decisions, steps, windows
from tiltmeter.plans import runs
from tiltmeter.sources import demo
from tiltmeter.streaming.windows import decide_stream, start_decisions

EXPERIMENT = Experiment(freq="1 day", targets=TargetRules(min_posts=10))


def test_sweep_run_writes_every_table(spark, data, tmp_path):
    answer = F.when(F.col("positive_ratio") > 0.2, "Answer: buy").otherwise("Answer: hold")
    paths = runs.sweep_run(demo.scored_posts(spark, data), str(tmp_path), EXPERIMENT, model=answer, save_posts=True)
    assert {"windows", "trajectories", "sweep_adr_table", "consensus_table", "injection_flip_table", "datasets"} <= set(paths)
    assert spark.read.csv(paths["sweep_adr_table"], header=True).count() == 18
    assert spark.read.csv(paths["family_action_distribution"], header=True).count() == 72
    saved = spark.read.parquet(paths["datasets"])
    assert saved.where("dataset = 'jitter_5'").count() == 1000
    assert len(glob.glob(f"{paths['datasets']}/dataset=*")) == 10
    plan = saved.where("dataset = 'jitter_5'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_step_runs(spark, data, tmp_path):
    market = demo.market_steps(spark, data)
    paths = runs.drift_run(market, str(tmp_path / "drift"))
    text = "\n".join(r.value for r in spark.read.text(paths["drift_pnl_comparison"]).collect())
    assert "temporal_jitter_n3" in text and "Tied" in text and "sentiment_lag" not in text
    for name in ("intensity_k2", "temporal_jitter_n3"):
        report = "\n".join(r.value for r in spark.read.text(paths[f"drift_report_{name}"]).collect())
        pair = [spark.read.json(paths[f"traj_{n}"]) for n in (BASELINE, name)]
        changed = steps.drift_steps(*pair).first().mismatched_steps
        assert report.startswith("Drift of decisions") and f" {changed} of all steps" in report and (changed == 0) == (name != "intensity_k2")
    paths = runs.drift_run(market, str(tmp_path / "late"), lag_sentiment=True)
    late = [spark.read.json(paths[f"traj_{n}"]).select("step", "action_taken", "oracle_triggered") for n in (BASELINE, "sentiment_lag_n3")]
    assert steps.drift_steps(*late).first().mismatched_steps > 0
    assert "changed" in "".join(r.value for r in spark.read.text(paths["drift_report_sentiment_lag_n3"]).collect())
    paths = runs.hybrid_run(market, str(tmp_path / "hybrid"), sample=100)
    assert spark.read.json(paths["combined_log"]).count() == 100
    labelled = market.select("step", "timestamp", "cryptocurrency", F.lit("up").alias("tweet_text"),
                             F.when(F.col("social_sentiment_score") > 0, "positive").otherwise("negative").alias("label"))
    paths = runs.post_level_run(labelled, str(tmp_path / "posts"), lambda t, rsi, vol: F.when(rsi > 55, "BUY").otherwise("SELL"))
    text = "\n".join(r.value for r in spark.read.text(paths["drift_report"]).collect())
    assert "Drift of decisions under" in text and "overrides, before and after" in text


def test_baseline_is_scored_once(spark, data, tmp_path):
    raw = demo.raw_posts(spark, data)
    path = str(tmp_path / "scored")
    first = runs.score_baseline(raw, path, topics=demo.DEMO_TOPICS)
    again = runs.score_baseline(raw.limit(0), path, topics=demo.DEMO_TOPICS)
    assert first.count() == again.count() > 0
    assert windows.window_features(first, "1 hour").count() > 0


def test_stream_equals_batch_on_closed_windows(spark, data, tmp_path):
    source = tmp_path / "in"
    late_ok = "30 minutes"
    posts = demo.scored_posts(spark, data).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    # Several files, written in time order, read one per trigger.
    for i in range(3):
        posts.where(F.expr(f"int((dayofmonth(timestamp) - 1) / 10) = {i}")).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    start_decisions(decide_stream(stream, "6 hours", late_ok), out, str(tmp_path / "state"), once=True).awaitTermination()
    got = {(r.window_id): r for r in spark.read.parquet(out).collect()}
    last = posts.agg(F.max("timestamp")).first()[0]
    closed = windows.window_features(posts, "6 hours").where(F.col("window_end") <= F.lit(last) - F.expr("INTERVAL 30 MINUTES"))
    want = {r.window_id: r for r in decisions.rule_agent(closed).collect()}
    assert set(got) == set(want) and len(got) > 200
    assert all(got[k].action_taken == want[k].action_taken and got[k].tweet_count == want[k].tweet_count for k in want)


def test_staging_follows_the_session(spark, tmp_path):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.staging_root(spark) == configured.rstrip("/")
    staged = session.stage(spark.range(10), "t")
    assert configured in staged.inputFiles()[0] and staged.count() == 10


def test_staging_refuses_a_private_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.staging_root(Session())


def test_scope_removes_what_it_staged(spark):
    kept = session.stage(spark.range(3), "kept")
    with session.staging_scope(spark):
        inner = session.stage(spark.range(4), "inner")
        assert inner.count() == 4
        path = inner.inputFiles()[0].removeprefix("file://")
    assert not glob.glob(path) and kept.count() == 3
