import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import labels, numeric
from tiltmeter.functions.ordering import global_index, grouped_index, over_previous_rows, running_sum
from tiltmeter.functions.quantiles import exact_percentiles, percentiles_of


def test_half_even_shares(spark):
    df = spark.createDataFrame([(2, 64), (10, 64), (0, 0), (1, 3)], "a int, b int")
    got = [r[0] for r in df.select(numeric.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [3.12, 15.62, 0.0, 33.33]
    texts = [r[0] for r in df.select(numeric.share_text(F.col("a"), F.col("b"))).collect()]
    assert texts == ["2/64 (3.1%)", "10/64 (15.6%)", "0/0 (0.0%)", "1/3 (33.3%)"]


def test_clip_keeps_null_and_cleans_nan(spark):
    df = spark.createDataFrame([(2.0,), (-3.0,), (0.5,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(numeric.clip(numeric.clean_double("x"), -1.0, 1.0)).collect()]
    assert got == [1.0, -1.0, 0.5, None, None]


def test_clean_double_reads_text(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in df.select(numeric.clean_double("x")).collect()] == [1.5, None, None]


def test_buckets_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (7.5,), (12.5,), (52.4,)], "x double")
    assert [r[0] for r in df.select(numeric.bucketed(F.col("x"), 5)).collect()] == [0, 10, 10, 50]


def test_draw_depends_on_key_only(spark):
    ids = spark.range(200).select(F.col("id").cast("string").alias("id"))
    draw = numeric.keyed_draw(527, "jitter", "id")
    a = {r.id: r.d for r in ids.repartition(7).select("id", draw.alias("d")).collect()}
    b = {r.id: r.d for r in ids.coalesce(1).select("id", draw.alias("d")).collect()}
    assert a == b and len(set(a.values())) == 200 and min(a.values()) >= 0


def test_label_ties_and_maps(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 2, 2), (0, 1, 2)], "p int, u int, n int")
    got = [r[0] for r in df.select(labels.dominant(F.col("p"), F.col("u"), F.col("n"))).collect()]
    assert got == ["positive", "neutral", "negative"]
    scores = spark.createDataFrame([(0.05,), (0.051,), (-0.05,), (-0.06,), (None,)], "s double")
    assert [r[0] for r in scores.select(labels.label_from_score(F.col("s"))).collect()] == [
        "neutral", "positive", "neutral", "negative", "neutral"]
    names = spark.createDataFrame([("positive",), ("negative",), ("Neutral",), ("POSITIVE",), (None,)], "l string")
    assert [tuple(r) for r in names.select(
        labels.score_from_label(F.col("l")), labels.action_from_label(F.col("l")),
    ).collect()] == [(1.0, "BUY"), (-1.0, "SELL"), (0.0, "HOLD"), (0.0, "BUY"), (0.0, "HOLD")]


@pytest.fixture(scope="module")
def series(spark):
    # A third of the rows share one time; ids settle the order.
    rng = np.random.default_rng(7)
    times = np.where(rng.random(900) < 0.34, 50, rng.integers(0, 1000, 900))
    rows = [(int(t), i, float(rng.integers(-9, 9)), "a" if i % 3 else "b") for i, t in enumerate(times)]
    return rows, spark.createDataFrame(rows, "t long, id long, x double, g string").repartition(5)


def test_global_index(series):
    rows, df = series
    got = {r.id: r.step for r in global_index(df, ["t", "id"]).collect()}
    want = {row[1]: i for i, row in enumerate(sorted(rows))}
    assert got == want


def test_grouped_index(series):
    rows, df = series
    got = {r.id: r.step for r in grouped_index(df, ["g"], ["t", "id"]).collect()}
    for g in ("a", "b"):
        want = [row[1] for row in sorted(r for r in rows if r[3] == g)]
        assert [got[i] for i in want] == list(range(len(want)))


@pytest.mark.parametrize("block", [14, 64, 1 << 16])
def test_frames_and_sums_do_not_depend_on_blocks(series, block):
    rows, df = series
    ordered = sorted(rows)
    x = np.array([r[2] for r in ordered])
    placed = global_index(df, ["t", "id"])
    rolled = over_previous_rows(placed, "step", 13, lambda w: {
        "mean": F.avg("x").over(w.rowsBetween(-13, 0)), "before": F.lag("x", 3).over(w),
    }, block)
    got = {r.step: (r.mean, r.before) for r in rolled.collect()}
    assert len(got) == len(rows) == rolled.count()
    for i in range(len(x)):
        assert got[i][0] == pytest.approx(x[max(0, i - 13): i + 1].mean())
        assert got[i][1] == (x[i - 3] if i >= 3 else None)
    sums = {r.step: r.total for r in running_sum(placed, "step", F.col("x"), "total", block=block).collect()}
    assert [sums[i] for i in range(len(x))] == pytest.approx(np.cumsum(x).tolist())


def test_running_sum_through_three_levels(spark):
    df = spark.range(1000).select(F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("x"),
                                  F.explode(F.array(F.lit("p"), F.lit("q"))).alias("s"))
    got = running_sum(df, "step", F.col("x"), "total", ["s"], block=8)
    want = np.cumsum([i % 7 for i in range(1000)])
    rows = got.collect()
    assert len(rows) == 2000 and all(r.total == want[r.step] for r in rows)


def test_reach_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        over_previous_rows(spark.range(5).withColumnRenamed("id", "step"), "step", 9, lambda w: {}, 8)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_percentiles(spark, accuracy):
    rng = np.random.default_rng(3)
    groups = {
        "many": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0, 5.0], [900, 50, 1900]), "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("many", None), ("many", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs, accuracy).collect()}
    for k, values in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p)), (k, name)


def test_percentiles_of_large_groups_and_null_keys(spark):
    values = [(None if i % 2 else "a", float(i * 7919 % 30011)) for i in range(30000)]
    df = spark.createDataFrame(values, "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "high": 0.9}).collect()}
    for key in ("a", None):
        own = [v for k, v in values if k == key]
        assert [got[key].low, got[key].mid, got[key].high] == pytest.approx(np.percentile(own, [10, 50, 90]).tolist())


def test_percentiles_of_several_columns(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, None), ("a", float("nan"), 7.0), ("b", None, 1.0), (None, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r for r in percentiles_of(
        df, ["k"], {"x50": ("x", 0.5), "y50": ("y", 0.5), "x100": ("x", 1.0)}, {"n": F.count(F.lit(1))}).collect()}
    assert (got["a"].x50, got["a"].y50, got["a"].x100, got["a"].n) == (1.5, 6.0, 2.0, 3)
    assert (got["b"].x50, got["b"].y50, got["b"].n) == (None, 1.0, 1)
    assert (got[None].x50, got[None].x100, got[None].n) == (3.0, 3.0, 1)
    assert percentiles_of(df.where("false"), ["k"], {"x50": ("x", 0.5)}, {"n": F.count(F.lit(1))}).count() == 0
