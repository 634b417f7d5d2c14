"""Registered queries against their SQL twins on the smallest tables; `checks.compare` runs all of them."""

import pytest

from checks.catalog import QUERIES
from checks.compare import compare, connect
from checks.oracles import ORACLES

NAMES = [
    "read_posts_csv", "normalize_scored", "finalize_dataset", "normalize_text", "parse_tags", "detect_topics", "clean_posts",
    "dedup_posts", "parse_answer", "render_window_text", "score_udf", "score_distinct", "heuristic_policy", "decide_bucketed",
    "time_jitter", "row_lag", "market_frame", "inject_posts", "window_features", "sweep_adr", "consensus", "timeline",
    "drift_steps", "pnl_steps", "text_report", "stream_windows", "ingest_posts", "read_market_steps", "score_store", "score_truncated",
    "csv_lists", "kept_windows", "stream_unique",
]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data, name):
    assert compare(spark, con, name, data).startswith("ok")
