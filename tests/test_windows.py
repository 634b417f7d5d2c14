import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tiltmeter.config import BASELINE, Experiment, Sweep, TargetRules
from tiltmeter.operators import injection, perturb, windows
from tiltmeter.plans.sweep import default_scorer, run_sweep, run_sweep_rows
from tiltmeter.operators.scoring import add_scores
from tiltmeter.sources import demo

T0 = dt.datetime(2022, 11, 30, 9, 0, tzinfo=dt.timezone.utc)
POSTS = "tweet_id string, timestamp timestamp, cryptocurrency string, finbert_label string, sentiment_score double, sentiment_confidence double, is_synthetic boolean"


def posts(spark, rows):
    """rows: (topic, minute, label, score)"""
    return spark.createDataFrame(
        [(str(i), T0 + dt.timedelta(minutes=m), c, l, s, 0.5, None) for i, (c, m, l, s) in enumerate(rows)], POSTS,
    )


def window(spark, **given):
    base = dict(
        window_id="BTC_x", window_start=T0, window_end=T0 + dt.timedelta(minutes=5), cryptocurrency="BTC", tweet_count=20,
        synthetic_count=0, positive_count=0, neutral_count=20, negative_count=0, positive_ratio=0.0, neutral_ratio=1.0,
        negative_ratio=0.0, mean_sentiment_score=0.0, sentiment_std=0.1, sentiment_intensity=0.1,
        mean_sentiment_confidence=0.5, dominant_label="neutral", regime="neutral",
    )
    return {**base, **given}


def frame(spark, rows):
    from tiltmeter.schemas import WINDOW

    return spark.createDataFrame([tuple(window(spark, **r)[c] for c in WINDOW.names) for r in rows], WINDOW)


def test_single_post_window(spark):
    w = windows.window_features(posts(spark, [("BTC", 1, "Positive", 0.4)]), "5 minutes").first()
    assert (w.tweet_count, w.positive_count, w.sentiment_std, w.synthetic_count) == (1, 1, 0.0, 0)
    assert w.window_id == "BTC_20221130T090000Z" and w.regime == "sparse" and w.window_end - w.window_start == dt.timedelta(minutes=5)


def test_window_values_and_null_scores(spark):
    rows = [("BTC", 0, "positive", 0.5), ("BTC", 4, "negative", -0.1), ("BTC", 2, "neutral", None), ("BTC", 5, "neutral", 0.0),
            ("ETH", 1, "neutral", float("nan"))]
    got = {(r.cryptocurrency, r.window_start.minute): r for r in windows.window_features(posts(spark, rows), "5 minutes").collect()}
    a = got["BTC", 0]
    assert a.tweet_count == 3 and a.mean_sentiment_score == pytest.approx(0.2)
    assert a.sentiment_std == pytest.approx(np.std([0.5, -0.1])) and a.sentiment_intensity == pytest.approx(0.3)
    assert a.positive_ratio == pytest.approx(1 / 3) and a.dominant_label == "positive"
    assert got["BTC", 5].tweet_count == 1 and got["ETH", 0].mean_sentiment_score is None
    tie = windows.window_features(posts(spark, [("BTC", 0, l, 0.0) for l in ("neutral", "negative") * 2]), "5 minutes")
    assert tie.first().dominant_label == "neutral"


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="finbert_label"):
        windows.window_features(posts(spark, [("BTC", 0, "x", 0.0)]).drop("finbert_label"), "5 minutes")


def test_features_do_not_depend_on_partitioning(spark, data):
    scored = demo.scored_posts(spark, data)
    a = windows.window_features(scored, "6 hours").orderBy("window_id").collect()
    b = windows.window_features(scored.repartition(7), "6 hours").orderBy("window_id").collect()
    assert [r.window_id for r in a] == [r.window_id for r in b]
    assert [r.sentiment_std for r in a] == pytest.approx([r.sentiment_std for r in b])


def test_one_shuffle_with_map_side_combine(spark, data):
    plan = plan_of(windows.window_features(demo.scored_posts(spark, data), "6 hours"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate") == 2
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_regime_edges(spark):
    cases = [
        (dict(tweet_count=19), "sparse"),
        (dict(positive_ratio=0.35, negative_ratio=0.35), "high_conflict"),
        (dict(mean_sentiment_score=0.15, positive_ratio=0.449), "neutral"),
        (dict(mean_sentiment_score=0.15, positive_ratio=0.45), "mixed"),
        (dict(mean_sentiment_score=0.1501), "mixed"),
        (dict(positive_ratio=0.60, mean_sentiment_score=0.5), "positive_skew"),
        (dict(negative_ratio=0.60, mean_sentiment_score=-0.5), "negative_skew"),
        (dict(mean_sentiment_score=None), "mixed"),
    ]
    got = [r[0] for r in frame(spark, [c for c, _ in cases]).select(windows.regime()).collect()]
    assert got == [want for _, want in cases]


def test_targets_prefer_near_neutral_and_split_by_topic(spark):
    rows = [dict(window_id=f"{c}_{i}", cryptocurrency=c, tweet_count=20 + i, mean_sentiment_score=(i - 5) / 100,
                 window_start=T0 + dt.timedelta(minutes=5 * i)) for c in ("BTC", "ETH") for i in range(11)]
    rows.append(dict(window_id="far", tweet_count=500, mean_sentiment_score=0.09))
    rows.append(dict(window_id="small", tweet_count=19, mean_sentiment_score=0.0))
    got = injection.select_targets(frame(spark, rows)).collect()
    assert len(got) == 16 and {"far", "small"}.isdisjoint(r.window_id for r in got)
    btc = sorted((r for r in got if r.cryptocurrency == "BTC"), key=lambda r: r.mean_sentiment_score)
    assert [r.tweet_count for r in btc] == list(range(23, 31))
    assert [r.adversarial_direction for r in btc] == ["positive_injection"] * 4 + ["negative_injection"] * 4


def test_targets_fall_back_when_nothing_is_neutral(spark):
    rows = [dict(window_id=f"w{i}", tweet_count=30 + i, mean_sentiment_score=0.2 + i / 100) for i in range(3)]
    rows.append(dict(window_id="small", tweet_count=3, mean_sentiment_score=0.5))
    assert {r.window_id for r in injection.select_targets(frame(spark, rows)).collect()} == {"w0", "w1", "w2"}


def test_single_direction_is_split_again(spark):
    rows = [dict(window_id="a", mean_sentiment_score=0.05), dict(window_id="b", cryptocurrency="ETH", mean_sentiment_score=0.01)]
    got = {r.window_id: r.adversarial_direction for r in injection.select_targets(frame(spark, rows)).collect()}
    assert got == {"a": "negative_injection", "b": "positive_injection"}
    one = injection.select_targets(frame(spark, rows[:1])).collect()
    assert [r.adversarial_direction for r in one] == ["positive_injection"]
    assert injection.select_targets(frame(spark, [dict(tweet_count=2)])).count() == 0


def test_synthetic_counts(spark):
    cases = [(1, 0.10, 3), (20, 0.10, 3), (300, 0.10, 30), (1, 0.35, 3), (20, 0.35, 7), (300, 0.35, 75), (175, 0.2, 35)]
    df = spark.createDataFrame([c[:2] for c in cases], "n long, r double")
    assert [r[0] for r in df.select(injection.synthetic_count(F.col("n"), F.col("r"))).collect()] == [c[2] for c in cases]


def test_synthetic_posts_stay_in_their_window(spark):
    rows = [dict(window_id=f"{c}_{i}", cryptocurrency=c, tweet_count=60, window_start=T0 + dt.timedelta(minutes=5 * i),
                 window_end=T0 + dt.timedelta(minutes=5 * i + 5), mean_sentiment_score=i / 100) for c in ("BTC", "SOL") for i in range(4)]
    plan = injection.injection_plan(injection.select_targets(frame(spark, rows)))
    made = injection.inject_posts(plan)
    both = add_scores(made, default_scorer(Experiment()))
    starts = {r["window_id"]: r["window_start"] for r in rows}
    got = both.collect()
    assert len(got) == 8 * (6 + 12 + 21) and len({r.tweet_id for r in got}) == len(got)
    for r in got:
        offset = r.timestamp.replace(tzinfo=dt.timezone.utc) - starts[r.target_window_id]
        assert dt.timedelta(0) < offset < dt.timedelta(minutes=5)
        wants = "positive" if r.adversarial_direction == "positive_injection" else "negative"
        assert r.finbert_label == wants and r.username == f"synthetic_{wants}"
    assert all("BTC" in r.tweet_text or "Bitcoin" in r.tweet_text for r in got if r.cryptocurrency == "SOL")
    again = {r.tweet_id: (r.timestamp, r.tweet_text) for r in injection.inject_posts(plan.repartition(3)).collect()}
    assert again == {r.tweet_id: (r.timestamp, r.tweet_text) for r in got}


def test_amplify_and_jitter_keep_rows(spark, data):
    scored = demo.scored_posts(spark, data)
    louder = perturb.amplify(scored, 2.0)
    assert louder.count() == scored.count() == 1000
    bad = louder.where((F.abs("sentiment_score") > 1) | (F.signum("sentiment_score") != F.signum("sentiment_score_original")))
    assert bad.count() == 0
    moved = perturb.time_jitter(scored, 5)
    shifts = [r.time_shift_minutes for r in moved.collect()]
    assert set(shifts) == set(range(-5, 6)) and len(shifts) == 1000
    assert moved.where(F.expr("timestamp <> timestamp_original + make_dt_interval(0, 0, time_shift_minutes)")).count() == 0
    null = perturb.amplify(spark.createDataFrame([(None,)], "sentiment_score double"), 2.0)
    assert null.first().sentiment_score is None


@pytest.fixture(scope="module")
def small_sweep(spark, data):
    # A lower size limit, so that the smallest tables have targets.
    experiment = Experiment(freq="1 day", targets=TargetRules(min_posts=10))
    scored = demo.scored_posts(spark, data)
    return experiment, run_sweep(scored, experiment), run_sweep_rows(scored, experiment)


def test_fused_sweep_equals_the_row_by_row_one(spark, small_sweep):
    experiment, tables, rows = small_sweep
    naive = {(r.dataset, r.window_id): r for r in windows.window_features(rows, experiment.freq).collect()}
    fused = tables.windows.collect()
    assert len(fused) == len(naive)
    assert {r.dataset for r in fused} == {v.dataset for v in experiment.sweep.variants()}
    for r in fused:
        other = naive[r.dataset, r.window_id]
        for name in windows.WINDOW_COLUMNS:
            a, b = r[name], other[name]
            assert a == (pytest.approx(b, abs=1e-12) if isinstance(a, float) else b), (r.dataset, r.window_id, name)
    assert tables.plan.count() == 3 * tables.targets.count() > 0


def test_sweep_reads_the_posts_once(spark, data):
    from tiltmeter.plans.sweep import _observed_windows

    plan = plan_of(_observed_windows(demo.scored_posts(spark, data), Experiment(freq="6 hours")))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Python" not in plan


def test_registry_and_names():
    names = [v.dataset for v in Sweep().variants()]
    assert names == [BASELINE, "sentiment_1.25", "sentiment_1.5", "sentiment_2.0", "jitter_5", "jitter_15", "jitter_30",
                     "injection_0.10", "injection_0.20", "injection_0.35"]
    assert Sweep().main_datasets() == [BASELINE, "sentiment_1.5", "jitter_15", "injection_0.20"]
    assert [v.label for v in Sweep().variants()][-1] == "Injection 35%"


def test_pooled_windows_with_null_scores(spark):
    rows = [("BTC", i / 10, "neutral", None if i % 2 else 0.01) for i in range(40)] + [("ETH", i / 10, "neutral", None) for i in range(40)]
    experiment = Experiment()
    scored = posts(spark, rows)
    fused = {(r.dataset, r.window_id): r for r in run_sweep(scored, experiment).windows.collect()}
    for r in windows.window_features(run_sweep_rows(scored, experiment), experiment.freq).collect():
        other = fused[r.dataset, r.window_id]
        for name in ("tweet_count", "mean_sentiment_score", "sentiment_std", "sentiment_intensity", "mean_sentiment_confidence"):
            a, b = r[name], other[name]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-12)), (r.dataset, name, a, b)
