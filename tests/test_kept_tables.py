"""Versioned tables, kept scores and window states, typed ingestion, observed checks, many experiments at once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import plan_of
from tiltmeter.config import BASELINE, Experiment, Sweep, TargetRules
from tiltmeter.operators import decisions, perturb, scoring, steps, windows
from tiltmeter.operators.window_state import WindowStates, merge_states, window_state, windows_of
from tiltmeter.plans import runs
from tiltmeter.sources import demo, ingest, registry, sinks
from tiltmeter.sources.score_store import ScoreStore
from tiltmeter.sources.versions import VersionedTable

NUMBERS = T.StructType([T.StructField("x", T.LongType())])


def numbers(frame):
    return sorted(r.x for r in frame.collect())


def test_versions_are_whole_or_absent(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), NUMBERS)
    assert table.latest() == 0 and table.read().count() == 0
    first = table.append(spark.range(3).toDF("x"), 0)
    orphan = table.write(spark.range(100).toDF("x"))  # a writer that died before its commit
    assert first == 1 and numbers(table.read()) == [0, 1, 2]
    held = table.read(1)
    assert table.append(spark.range(7, 9).toDF("x"), 1) == 2 and numbers(table.read()) == [0, 1, 2, 7, 8] and numbers(held) == [0, 1, 2]
    assert not table.commit(2, [orphan]) and numbers(table.read()) == [0, 1, 2, 7, 8]  # the second writer of a version loses
    late = table.append(spark.range(2, 4).toDF("x"), 1, lambda mine, theirs: mine.join(theirs, "x", "left_anti"))
    assert late == 3 and numbers(table.read()) == [0, 1, 2, 2, 3, 7, 8]
    assert table.replace(table.read().distinct(), 3) and not table.replace(table.read(), 3) and len(table.batches()) == 1
    assert table.vacuum() >= 4 and numbers(table.read()) == [0, 1, 2, 3, 7, 8]


def test_second_run_scores_only_new_texts(spark, tmp_path):
    class Model:
        def __call__(self, texts):
            return [(1.0, 0.0, 0.0) if "good" in t else (0.0, 0.0, 1.0) for t in texts]

    def model(col):
        return scoring.model_probabilities(col, Model)

    store = ScoreStore(spark, str(tmp_path / "s"), digits=1)
    posts = [(1, "good one"), (2, "bad"), (3, " good one "), (4, None), (5, "new"), (6, "bad")]
    schema = "id long, tweet_text string"
    first = scoring.score_new(spark.createDataFrame(posts[:4], schema), model, store).collect()
    assert {r.id: (r.finbert_label, r.score_batch) for r in first} == {1: ("positive", 1), 2: ("negative", 1), 3: ("positive", 1), 4: ("negative", 1)}
    second = scoring.score_new(spark.createDataFrame(posts, schema), model, store).collect()
    assert {r.id: r.score_batch for r in second} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1} and store.latest() == 2
    assert store.table.read(batches=store.table.batches()[1:]).count() == 1
    scoring.score_new(spark.createDataFrame(posts, schema), model, store)
    assert store.latest() == 2  # nothing new, no version
    assert store.compact() and store.read().count() == 4 and {r.prefix for r in store.read().collect()} == {r.text_md5[:1] for r in store.read().collect()}
    assert "Filter (" not in plan_of(store.read(prefixes=["a"])) and "+- *(1) Filter" not in plan_of(store.read(prefixes=["a"]))  # folders are left out, no row is tested


def test_baseline_through_a_store(spark, data, tmp_path):
    raw = demo.raw_posts(spark, data).where("cast(index as int) < 60")
    plain = runs.score_baseline(raw, str(tmp_path / "a"), topics=demo.DEMO_TOPICS)
    kept = runs.score_baseline(raw, str(tmp_path / "b"), topics=demo.DEMO_TOPICS, store=str(tmp_path / "store"))
    assert sorted(map(tuple, plain.select("tweet_id", "sentiment_score").collect())) == sorted(map(tuple, kept.select("tweet_id", "sentiment_score").collect()))


def test_every_row_is_good_or_rejected(spark, tmp_path):
    lines = ["index,Date,Content", "1,2024-01-02 03:04:05,fine", "2,02/01/2024 03:04,fine too", '3,"Jan 2, 2024 3:04 PM","a, b"', "4,never,text", "5,2024-01-02,  ", "6,2024-01-02,a,b,c", "7,,text", "8"]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    good, rejected = ingest.ingest_posts(spark, str(tmp_path / "x.csv"))
    assert {r["index"]: r.Date for r in good.collect()} == {"1": dt.datetime(2024, 1, 2, 3, 4, 5), "2": dt.datetime(2024, 1, 2, 3, 4), "3": dt.datetime(2024, 1, 2, 15, 4)}
    told = {(r["index"] if r._bad_row is None else "line"): r.reason for r in rejected.collect()}
    assert told == {"4": "unreadable time", "5": "empty text", "line": "too many fields", "7": "unreadable time", "8": "unreadable time"}


def test_market_steps_need_a_total_order(spark, tmp_path):
    head = "timestamp,cryptocurrency,rsi_technical_indicator,nr"
    (tmp_path / "a.csv").write_text(f"{head}\n2024-01-01 00:05:00,BTC,50,2\n2024-01-01 00:05:00,BTC,x,3\n2024-01-01 00:05:00,,1,4\n")
    (tmp_path / "b.csv").write_text("nr,cryptocurrency,timestamp\n1,BTC,2024-01-01 00:05:00\n9,ETH,01/01/2024 00:04\n,ETH,2024-01-01\n")
    order = T.StructType([T.StructField("nr", T.LongType())])
    good, rejected = ingest.read_market_steps(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], order)
    assert [(r.step, r.nr, r.rsi_technical_indicator) for r in good.orderBy("step").collect()] == [(0, 9, None), (1, 1, None), (2, 2, 50.0)]
    assert sorted(r.reason for r in rejected.collect()) == ["bad cryptocurrency", "bad nr", "bad rsi_technical_indicator"]
    with pytest.raises(ValueError, match="total order"):
        ingest.read_market_steps(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


def test_states_of_parts_give_the_windows_of_the_whole(spark, data, tmp_path):
    posts = demo.scored_posts(spark, data).withColumn("sentiment_score", F.expr("if(crc32(tweet_id) % 11 = 0, null, sentiment_score)"))
    whole = {r.window_id: r for r in windows.window_features(posts, "6 hours").collect()}
    parts = [window_state(posts.where(F.crc32("tweet_id") % 4 == k), "6 hours") for k in range(4)]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    merged = {r.window_id: r for r in windows_of(merge_states(stacked)).collect()}
    kept = WindowStates(spark, str(tmp_path / "w"), "6 hours")
    for k in range(2):
        kept.add(posts.where(F.crc32("tweet_id") % 2 == k))
    assert kept.compact()
    for got in (merged, {r.window_id: r for r in kept.windows().collect()}):
        assert set(got) == set(whole)
        for name, row in whole.items():
            for c in ("tweet_count", "positive_count", "dominant_label", "regime"):
                assert got[name][c] == row[c]
            for c in ("mean_sentiment_score", "sentiment_std", "sentiment_intensity", "mean_sentiment_confidence"):
                assert got[name][c] == (None if row[c] is None else pytest.approx(row[c], abs=1e-12))


def test_broken_sweep_is_noticed_without_a_scan(spark, data, tmp_path, monkeypatch):
    experiment = Experiment(freq="1 day", targets=TargetRules(min_posts=10))
    whole = runs.run_sweep
    monkeypatch.setattr(runs, "run_sweep", lambda *args: _without_some(whole(*args)))
    with pytest.raises(ValueError, match="jitter_5.*row count changed"):
        runs.sweep_run(demo.scored_posts(spark, data), str(tmp_path), experiment)
    sweep = Sweep()
    counts = {f"{v.dataset}|{c}": 10 if c == "tweet_count" else 0 for v in sweep.variants() for c in ("tweet_count", "synthetic_count")}
    plan = {f"{v.dataset}|{d}": 1 for v in sweep.variants() if v.family == "injection" for d in registry.DIRECTIONS}
    assert registry.observed_violations(sweep, counts, plan) == []
    assert registry.observed_violations(sweep, counts, {**plan, "injection_0.20|negative_injection": None}) == [("injection_0.20", "one direction only")]


def _without_some(tables):
    from dataclasses import replace

    return replace(tables, windows=tables.windows.where("not (dataset = 'jitter_5' and cryptocurrency = 'ETH')"))


def test_many_experiments_in_one_shuffle(spark, data, tmp_path):
    market = demo.market_steps(spark, data)
    logs = {BASELINE: decisions.step_rule_agent(market)} | {f"x{k}": decisions.step_rule_agent(perturb.amplify_steps(market, k)) for k in (1.5, 2.0, 4.0)}
    stacked = None
    for name, log in logs.items():
        one = log.withColumn("experiment", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    path = str(tmp_path / "logs")
    stacked.write.parquet(path)
    many = steps.drift_all(spark.read.parquet(path), BASELINE, list(logs)[1:])
    plan = plan_of(many)
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("hashpartitioning(step") == 1
    got = {r.experiment: r for r in many.collect()}
    for name in list(logs)[1:]:
        one = steps.drift_steps(logs[BASELINE], logs[name]).first()
        assert all(got[name][c] == one[c] for c in one.__fields__)
    short = spark.read.parquet(path).where("not (experiment = 'x2.0' and step = 5)")
    with pytest.raises(Exception, match="differ in length"):
        steps.drift_all(short, BASELINE, ["x1.5", "x2.0"]).collect()


def test_nan_readings_hold(spark):
    row = spark.createDataFrame([(1, float("nan"), 50.0), (2, 0.0, float("nan"))], "step long, social_sentiment_score double, rsi_technical_indicator double")
    assert {r.a for r in row.select(decisions.step_rule().alias("a")).collect()} == {"HOLD"}


def test_lists_survive_the_csv_sink(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, ["a,b", 'q"'], None)], "i int, tags array<string>, more array<string>"), str(tmp_path / "c"))
    row = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "c")).first()
    assert row.tags == '["a,b","q\\""]' and row.more is None
