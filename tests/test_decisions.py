import datetime as dt

import pytest
from pyspark.sql import functions as F

from tiltmeter.config import Sweep
from tiltmeter.operators import compare, decisions, perturb, pnl, reports, scoring, steps
from tiltmeter.sources import demo
from tiltmeter.sources.registry import dataset_qa, dataset_registry, main_views, qa_violations

STEP = "step long, timestamp string, cryptocurrency string, social_sentiment_score double, news_impact_score double, rsi_technical_indicator double, volatility_index double, fear_greed_index double, current_price_usd double, price_change_24h_percent double"
LOG = "agent string, dataset string, window_id string, cryptocurrency string, window_start string, action_taken string, oracle_triggered boolean, synthetic_count long"


def market(spark, rows):
    """rows: (score, rsi, volatility, change)"""
    return spark.createDataFrame(
        [(i, f"2022-01-01 00:00:{i:02d}", "BTC", float(s), float(s), float(r), float(v), 50.0, 100.0, float(c)) for i, (s, r, v, c) in enumerate(rows)], STEP,
    )


def log(spark, rows):
    """rows: (agent, dataset, window, action)"""
    return spark.createDataFrame([(a, d, w, "BTC", w, x, x == "HOLD", 1 if w == "w0" else 0) for a, d, w, x in rows], LOG)


def test_window_policy_edges(spark):
    rows = [(0.04, 0.30, 0.09), (0.0401, 0.0, 0.0), (-0.01, 0.31, 0.08), (-0.011, 0.31, 0.081), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "mean_sentiment_score double, sentiment_std double, negative_ratio double")
    got = [tuple(r) for r in df.select(decisions.window_policy(), decisions.window_risk()).collect()]
    assert got == [("HOLD", False), ("BUY", False), ("HOLD", False), ("SELL", True), ("HOLD", False)]


def test_step_policy_edges(spark):
    df = market(spark, [(0.51, 69, 0, 0), (0.51, 70, 0, 0), (0.5, 50, 0, 0), (-0.31, 10, 0, 0), (0.9, 81, 0, 0), (0.9, 10, 90, 0), (0.9, 10, 91, 0)])
    got = [(r.policy_action, r.action_taken, r.oracle_triggered) for r in decisions.step_rule_agent(df).orderBy("step").collect()]
    assert got == [("BUY", "BUY", False), ("HOLD", "HOLD", False), ("HOLD", "HOLD", False), ("SELL", "SELL", False),
                   ("SELL", "SELL", False), ("BUY", "BUY", False), ("BUY", "HOLD", True)]


def test_composite_trace(spark):
    row = decisions.composite_agent(market(spark, [(0.9, 20, 10, 30)])).first()
    assert row.reasoning == ("Composite=+0.750 | sentiment=+0.900(x0.50) rsi_factor=+0.600(x0.25) momentum=+1.000(x0.15) "
                             "fear_greed=+0.000(x0.10) -> positive")
    assert (row.raw_label, row.action_taken) == ("positive", "BUY")


def test_step_sentence(spark):
    text = market(spark, [(-0.2, 25.25, 0, -3.25)]).select(decisions.step_text()).first()[0]
    assert text == "BTC moved down 3.2% with negative social sentiment. RSI is oversold at 25.2. Fear and greed index is 50."


def test_bucketed_decisions_reuse_the_first_answer(spark):
    df = market(spark, [(0, 51, 10, 0), (0, 49, 10, 0), (0, 52.5, 10, 0), (0, 52.6, 10, 0), (0, 51, 10, 0)]).withColumn(
        "tweet_text", F.when(F.col("step") == 4, "other").otherwise(" same "))
    out = decisions.decide_bucketed(df.repartition(3), lambda t, rsi, vol: F.when(rsi > 50, "BUY").otherwise("SELL"))
    got = {r.step: (r.action_taken, r.asked_at, r.cached) for r in out.collect()}
    assert got == {0: ("BUY", 0, False), 1: ("BUY", 0, True), 2: ("BUY", 0, True), 3: ("BUY", 3, False), 4: ("BUY", 4, False)}


def test_model_agent_runs_in_batches(spark):
    df = spark.createDataFrame(
        [("w1", dt.datetime(2022, 1, 1), "BTC", 30, 0.5, 0.4, 0.6, 0.2, 0.2, 0), ("w2", dt.datetime(2022, 1, 1), "ETH", 5, -0.1, 0.1, 0.0, 0.9, 0.1, 2)],
        "window_id string, window_start timestamp, cryptocurrency string, tweet_count long, mean_sentiment_score double, sentiment_std double, "
        "positive_ratio double, neutral_ratio double, negative_ratio double, synthetic_count long")
    sizes = spark.sparkContext.accumulator(0)

    def factory():
        def reply(questions):
            sizes.add(1)
            return ["Answer: BUY" if "BTC" in q and "mean_sentiment=0.500" in q and "positive=60%" in q else "sell" for q in questions]
        return reply

    got = {r.window_id: (r.policy_action, r.action_taken, r.oracle_triggered, r.agent) for r in decisions.model_agent(df, factory).collect()}
    assert got == {"w1": ("BUY", "HOLD", True, "model"), "w2": ("SELL", "SELL", False, "model")}


def test_scores_come_with_their_row(spark):
    df = spark.createDataFrame([(i, "good strong" if i % 3 == 0 else "weak" if i % 3 == 1 else None) for i in range(30)], "id int, tweet_text string")

    def factory():
        return lambda texts: [(0.8, 0.1, 0.1) if "good" in t else (0.1, 0.1, 0.8) if "weak" in t else (0.1, 0.8, 0.1) for t in texts]

    out = scoring.add_scores(df.repartition(4), lambda c: scoring.model_probabilities(c, factory, 4)).collect()
    assert all(r.finbert_label == ["positive", "negative", "neutral"][r.id % 3] for r in out) and len(out) == 30
    with pytest.raises(ValueError):
        scoring.add_scores(df, scoring.lexicon_probabilities, "nope")


def test_distinct_texts_are_scored_once(spark):
    rows = [(i, "hot copy" if i % 3 else f"text {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, tweet_text string").repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def score(texts):
            seen.add(len(texts))
            return [(0.2, 0.3, 0.5)] * len(texts)
        return score

    out, cache = scoring.score_distinct(df, lambda c: scoring.model_probabilities(c, factory))
    assert out.count() == 90 and cache.count() == 31 and seen.value == 31
    more = spark.createDataFrame([(91, "hot copy"), (92, "new")], "id int, tweet_text string")
    again, grown = scoring.score_distinct(more, lambda c: scoring.model_probabilities(c, factory), cache=cache)
    assert again.count() == 2 and grown.count() == 32 and seen.value == 32


def test_adr(spark):
    table = log(spark, [
        ("r", "baseline", "w0", "BUY"), ("r", "baseline", "w1", "BUY"), ("r", "baseline", "w2", "HOLD"), ("r", "baseline", "gone", "SELL"),
        ("r", "jitter_5", "w0", "SELL"), ("r", "jitter_5", "w1", "BUY"), ("r", "jitter_5", "w2", "SELL"), ("r", "jitter_5", "extra", "BUY"),
    ])
    row = compare.adr(table, count_unmatched=True).first()
    assert (row.total, row.changed, row.adr, row.unmatched_base, row.unmatched_mut) == (3, 2, pytest.approx(2 / 3), 1, 1)
    same = table.where("dataset = 'baseline'")
    copy = same.unionByName(same.withColumn("dataset", F.lit("copy")))
    assert compare.adr(copy).first().adr == 0.0
    pairs = compare.matched(table)
    counts = compare.transitions(pairs, ["agent", "dataset"], "action_base", "action_taken")
    assert {r.transition: r["count"] for r in counts.collect()} == {"BUY>SELL": 1, "HOLD>SELL": 1}
    assert compare.transition_map(counts, ["agent", "dataset"]).first().transitions == {"BUY>SELL": 1, "HOLD>SELL": 1}


def test_top_flips_order(spark):
    base = [("r", "baseline", f"w{i}", "BUY" if i < 4 else "HOLD") for i in range(8)]
    # Equal counts stand in the order of their first window.
    new = ["HOLD", "SELL", "SELL", "HOLD", "SELL", "BUY", "BUY", "BUY"]
    table = log(spark, base + [("r", "jitter_5", f"w{i}", a) for i, a in enumerate(new)])
    assert compare.top_flips(table).first().top_flips == "HOLD>BUY:3 | BUY>HOLD:2 | BUY>SELL:2"
    row = compare.sweep_adr(table, dataset_registry(spark)).first()
    assert (row["ADR_%"], row.family, row.strength, row.matched_win, row.changed) == (100.0, "jitter", 5.0, 8, 8)


def test_consensus_and_matrix(spark):
    table = log(spark, [(a, "baseline", f"w{i}", x) for a, xs in (("deterministic", "BUY HOLD SELL BUY"), ("model", "BUY BUY SELL HOLD"))
                        for i, x in enumerate(xs.split())] + [("model", "baseline", "only", "BUY")])
    row = compare.consensus(table, dataset_registry(spark)).first()
    assert (row.total_windows, row.agree_windows, row["consensus_%"], row.top_disagree) == (4, 2, 50.0, "HOLD>BUY:1 | BUY>HOLD:1")
    cells = {r.rule_action: (r.BUY, r.SELL, r.HOLD) for r in compare.agreement_matrix(table).collect()}
    assert cells == {"BUY": (1, 0, 1), "SELL": (0, 1, 0), "HOLD": (1, 0, 0)}
    line = compare.timeline(table).orderBy("step").collect()
    assert [(r.step, r.first, r.second, r.agree) for r in line] == [(0, 1, 1, 1), (1, 0, 1, 0), (2, -1, -1, 1), (3, 1, 0, 0)]
    assert compare.agreement_share(compare.timeline(table)).first()["agree_%"] == 50.0


def test_distribution_is_zero_filled(spark):
    table = log(spark, [("r", "baseline", "w0", "BUY"), ("r", "jitter_5", "w0", "HOLD"), ("r", "jitter_5", "w1", "HOLD"), ("r", "jitter_5", "w2", "SELL")])
    rows = compare.action_distribution(table, dataset_registry(spark)).collect()
    assert len(rows) == 3 * 3 + 3
    got = {(r.family, r.dataset, r.action_taken): (r["count"], r.percent) for r in rows}
    assert got["sentiment", "baseline", "BUY"] == (1, 100.0) and got["jitter", "jitter_5", "BUY"] == (0, 0.0)
    assert got["jitter", "jitter_5", "HOLD"] == (2, 66.67)


def test_flips(spark):
    table = log(spark, [("r", "baseline", w, "BUY") for w in ("w0", "w1", "w2")] + [
        ("r", "injection_0.20", "w0", "SELL"), ("r", "injection_0.20", "w1", "HOLD"), ("r", "injection_0.20", "w2", "BUY")])
    row = compare.injection_flips(table, dataset_registry(spark)).first()
    assert (row.matched_windows, row.targeted_windows, row.flipped_targeted, row["targeted_flip_rate_%"], row.flipped_all, row["all_flip_rate_%"]) == (
        3, 1, 1, 100.0, 2, 66.67)
    assert {r.window_id: r.flip_class for r in compare.flip_classes(table, dataset_registry(spark)).collect()} == {
        "w0": "flipped_injected", "w1": "flipped_other", "w2": "stable"}


def test_drift_needs_equal_logs(spark):
    a = decisions.step_rule_agent(market(spark, [(0.6, 10, 0, 1)] * 6))
    b = decisions.step_rule_agent(market(spark, [(0.6, 10, 0, 1)] * 5))
    with pytest.raises(Exception, match="differ in length: 6 vs 5"):
        steps.drift_steps(a, b).collect()


def test_drift_consensus_and_reports(spark):
    base = market(spark, [(0.3, 10, 0, 1), (0.3, 10, 95, 1), (-0.2, 10, 0, -2), (0.0, 90, 0, 1)])
    rule, louder = decisions.step_rule_agent(base), decisions.step_rule_agent(perturb.amplify_steps(base, 2.0))
    report = steps.drift_steps(rule, louder)
    row = report.first()
    assert (row.total_steps, row.mismatched_steps, row.adr, row.oracle_violations, row.oracle_baseline) == (4, 2, 0.5, 0, 1)
    assert row.action_flips == {"HOLD -> BUY": 1, "HOLD -> SELL": 1}
    text = reports.drift_text(report).first().value
    assert "  steps            4" in text and "  changed          2 of all steps: 50.00 %" in text
    other = decisions.composite_agent(base)
    agreement = steps.consensus_steps(rule, other).first()
    assert agreement.total_steps == 4 and sum(agreement.rule_dist.values()) == 4 == sum(agreement.agent_dist.values())
    assert "  actions differ" in reports.consensus_text(steps.consensus_steps(rule, other)).first().value
    lagged = decisions.step_rule_agent(perturb.row_lag(base, 3))
    assert steps.drift_steps(rule, lagged).first().mismatched_steps == 0  # the rule agent does not read that column


def test_other_answers_count_as_disagreement(spark):
    table = log(spark, [("deterministic", "baseline", "w0", "BUY"), ("fingpt", "baseline", "w0", "WAIT")])
    agents = [r.agent for r in table.select("agent").distinct().collect()]
    pairs = compare.paired_agents(table, "deterministic", "fingpt").collect()
    assert len(agents) == 2 and [(r.action_first, r.action_second) for r in pairs] == [("BUY", "WAIT")]


def test_gaps_in_steps_are_an_error(spark):
    base = market(spark, [(float(i), 10, 0, 0) for i in range(6)])
    with pytest.raises(Exception, match="not dense"):
        perturb.row_lag(base.where("step <> 3"), 2, block=4).collect()


def test_pnl(spark):
    base = market(spark, [(0.6, 10, 0, 2), (0.6, 10, 0, -1), (-0.5, 10, 0, -3), (0.0, 10, 0, 5)])
    run = pnl.with_running_pnl(decisions.step_rule_agent(base)).orderBy("step").collect()
    assert [(r.pnl, r.cum_pnl) for r in run] == [(20.0, 20.0), (-10.0, 10.0), (30.0, 40.0), (0.0, 40.0)]
    total = pnl.pnl_summary(pnl.with_pnl(decisions.step_rule_agent(base)).withColumn("s", F.lit("x")), "s")
    row = total.first()
    assert (row.total_pnl, row.trade_count, row.win_count, row.loss_count, row.win_rate) == (40.0, 3, 2, 1, pytest.approx(2 / 3))
    assert reports.pnl_line(total, "s").first().value == f"  {'x':<24} | P&L:    +40.00 USD | Trades:    3 | Win rate:  66.7%"
    pairs = spark.createDataFrame([("e1", 1.0, 2.0), ("e2", 2.0, 1.0), ("e3", 1.0, 1.0)], "experiment string, pnl_a double, pnl_b double")
    assert [r.tag for r in pnl.pnl_compare(pairs).orderBy("experiment").collect()] == ["B better", "A better", "Tied"]


def test_row_lag_fills_gaps(spark):
    base = market(spark, [(float(i), 10, 0, 0) for i in range(6)]).withColumn("tweet_text", F.concat(F.lit("t"), "step"))
    rows = perturb.row_lag(base, 2, text="tweet_text", block=4).orderBy("step").collect()
    assert [r.news_impact_score for r in rows] == [2.5, 2.5, 0.0, 1.0, 2.0, 3.0]
    assert [r.tweet_text for r in rows][:3] == ["[NO DATA — tweet feed not yet started]"] * 2 + ["t0"]


def test_qa(spark):
    rows = [("baseline", False, "")] * 3 + [("sentiment_1.5", False, "")] * 2 + [("injection_0.20", False, "")] * 3 + [
        ("injection_0.20", True, "positive_injection")]
    df = spark.createDataFrame(rows, "dataset string, is_synthetic boolean, adversarial_direction string")
    qa = dataset_qa(df, dataset_registry(spark))
    assert [(r.dataset, r.rows, r.synthetic_rows) for r in qa.collect()] == [("baseline", 3, 0), ("injection_0.20", 4, 1), ("sentiment_1.5", 2, 0)]
    assert {r.dataset: r.reason for r in qa_violations(qa).collect()} == {
        "sentiment_1.5": "row count changed", "injection_0.20": "one direction only"}
    assert main_views(df, dataset_registry(spark), "v") == ["v_baseline", "v_sentiment", "v_jitter", "v_injection"]
    assert spark.table("v_injection").count() == 4


def test_market_frame(spark):
    labels = ["positive", "negative", "neutral", "positive", "positive"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "step long, label string")
    rows = perturb.market_frame(df).orderBy("step").collect()
    assert [r.rsi_technical_indicator for r in rows[:3]] == pytest.approx([100.0, 50.0, 50.0])
    assert rows[0].volatility_index == 0.0 and rows[1].volatility_index == 100.0
    assert [r.price_change_24h_percent for r in rows] == [0.0, 3.0, -3.0, 0.0, 3.0]


def test_texts_stay_out_of_the_block_shuffle(spark, tmp_path):
    rows = [(i, "positive", f"text {i}") for i in range(20)]
    spark.createDataFrame(rows, "step long, label string, tweet_text string").write.parquet(str(tmp_path / "steps"))
    steps = spark.read.parquet(str(tmp_path / "steps"))
    for late in (perturb.market_frame(steps, block=16), perturb.row_lag(perturb.market_frame(steps, block=16), 3, text="tweet_text", block=16)):
        blocks = [line for line in late._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(_block" in line]
        assert blocks
        tree = late._jdf.queryExecution().optimizedPlan()
        windows = [node for node in _nodes(tree) if node.nodeName() == "Window"]
        assert windows and not any("tweet_text" in str(node.output()) for node in windows)
    assert [r.tweet_text for r in late.orderBy("step").collect()][3:] == [f"text {i}" for i in range(17)]
    holes = spark.createDataFrame([(0, "positive"), (None, "negative")], "step long, label string")
    with pytest.raises(Exception, match="step is null"):
        perturb.market_frame(holes).collect()


def _nodes(plan):
    children = plan.children()
    return [plan] + [node for i in range(children.size()) for node in _nodes(children.apply(i))]


def test_short_names():
    assert Sweep.name("sentiment", 2) == "sentiment_2.0" and Sweep.name("injection", 0.1) == "injection_0.10"


def test_demo_inputs_cover_all_outcomes(spark, data):
    log_ = decisions.step_rule_agent(demo.market_steps(spark, data))
    assert {r.action_taken for r in log_.select("action_taken").distinct().collect()} == {"BUY", "SELL", "HOLD"}
