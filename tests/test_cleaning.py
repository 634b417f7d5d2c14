import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tiltmeter.operators import cleaning
from tiltmeter.schemas import CLEAN_POST
from tiltmeter.sources import posts, sinks

RAW = "`index` string, Date string, Content string, Hashtags string, URL string, Username string"


def test_clean_posts(spark):
    raw = spark.createDataFrame([
        ("1", "2022-11-30 09:15:01+00:00", "BTC  and\nETH", "['a']", None, "u"),
        ("2", "2022-11-30 09:14:01", "plain text", "['#Ethereum']", "http://x", None),
        ("3", "not a time", "btc", "", None, None),
        ("4", "2022-11-30", "   ", "['btc']", None, None),
        ("5", "2022-11-30", "no topic", "", None, None),
        (None, "2022-11-30 10:00:00", "bitcoin", None, None, None),
    ], RAW)
    clean = cleaning.clean_posts(raw)
    assert clean.columns == CLEAN_POST.names
    rows = clean.collect()
    assert [r.tweet_id for r in rows[:3]] == ["2:ETH", "1:BTC", "1:ETH"]
    assert rows[1].tweet_text == "BTC and ETH" and rows[1].hashtags == ["a"] and rows[1].url == ""
    assert len(rows) == 4 and rows[3].source_row_id not in ("", None, "5")
    joined = cleaning.clean_posts(raw, explode_multi_topic=False)
    assert "1:BTC_ETH" in {r.tweet_id for r in joined.collect()}


def test_content_id_survives_repartitioning(spark):
    raw = spark.createDataFrame([("2022-01-01", f"btc {i}") for i in range(50)], "Date string, Content string")
    a = {r.tweet_id for r in cleaning.clean_posts(raw).collect()}
    b = {r.tweet_id for r in cleaning.clean_posts(raw.repartition(9)).collect()}
    assert a == b and len(a) == 50


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Content"):
        cleaning.clean_posts(spark.createDataFrame([("x",)], "Date string"))


def test_keep_first_takes_the_first_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("k", i, f"text {i}") for i in range(100, 0, -1)], "k string, pos int, t string")
    first = cleaning.keep_first(df.repartition(4), ["k"], ["pos"])
    assert [(r.pos, r.t) for r in first.collect()] == [(1, "text 1")]
    plan = plan_of(first)
    assert plan.count("WindowGroupLimit") == 2  # once before the exchange, once after


def test_csv_round_trip_and_quarantine(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(
        'index,Date,Content,Hashtags\n1,2022-01-01,"two\nlines, ""quoted""",[]\n2,2022-01-02,short\n'
        "3,2022-01-03,too,many,fields\n4,2022-01-04,blank last,,extra\n5,2022-01-05, kept ,x\n"
    )
    good, bad = posts.read_posts_csv(spark, str(folder))
    got = {r["index"]: r for r in good.collect()}
    assert set(got) == {"1", "2", "5"}
    assert got["1"].Content == 'two\nlines, "quoted"' and got["2"].Hashtags is None and got["5"].Content == " kept "
    assert bad.count() == 2
    head, _ = posts.read_posts_csv(spark, str(folder), max_rows=2)
    assert [r["index"] for r in head.orderBy("_source_row").collect()] == ["1", "2"]


def test_files_are_read_with_their_own_headers(spark, tmp_path):
    folder = tmp_path / "orders of columns"
    folder.mkdir()
    (folder / "a.csv").write_text("index,Date,Content\n1,2022-01-01,btc one\n")
    (folder / "b.csv").write_text("Content,URL,index,Date\nbtc two,u,2,2022-01-02\ntoo,many,fields,in,it\n")
    good, bad = posts.read_posts_csv(spark, str(folder))
    assert sorted((r["index"], r.Date, r.Content, r.URL) for r in good.collect()) == [("1", "2022-01-01", "btc one", None), ("2", "2022-01-02", "btc two", "u")]
    assert bad.count() == 1 and cleaning.prepare_posts(good).count() == 2


def test_first_rows_over_many_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.csv").write_text("index,Date,Content\n" + "".join(f"{i * 10 + j},2022-01-01,t\n" for j in range(i)))
    order = [str(i * 10 + j) for i in range(7) for j in range(i)]
    for n in (0, 1, 3, 4, 20, 21, 50):
        head, _ = posts.read_posts_csv(spark, str(folder), max_rows=n)
        assert sorted(r["index"] for r in head.collect()) == sorted(order[:n])


def test_one_job_reads_all_headers(spark, tmp_path):
    folder = tmp_path / "head lines"
    folder.mkdir()
    for i in range(12):
        names = 'index,Date,Content,"two\nlines"' if i % 2 else "\nindex,Content,Date"
        (folder / f"{i:02d}.csv").write_text(f"{names}\n{i},2022-01-01,2022-01-01,x\n" if i % 2 else f"{names}\n{i},a,b\n")
    (folder / "99.csv").write_text("")

    def jobs(only):
        spark.sparkContext.setJobGroup(f"headers-{only}", "")
        found = posts._files_by_header(spark, [str(p) for p in sorted(folder.glob(only))], {"header": True, "multiLine": True})
        spark.sparkContext.setJobGroup("rest", "")
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers-{only}"))

    few, before = jobs("0[0-1].csv")
    many, after = jobs("*.csv")
    assert set(few) == set(many) == {("index", "Date", "Content", "two\nlines"), ("index", "Content", "Date")}
    assert [len(files) for files in many.values()] == [6, 6] and after == before


def test_duplicate_ids_keep_the_first_line(spark, tmp_path):
    folder = tmp_path / "dup"
    folder.mkdir()
    (folder / "a.csv").write_text("index,Date,Content\n7,2022-01-02,btc first\n7,2022-01-01,btc second\n")
    good, _ = posts.read_posts_csv(spark, str(folder))
    assert [r.tweet_text for r in cleaning.clean_posts(good).collect()] == ["btc first"]


def test_header_without_required_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        posts.read_posts_csv(spark, str(tmp_path / "x.csv"))


def test_normalize_scored(spark):
    df = spark.createDataFrame(
        [("2022-01-01 00:00:00", "0.2", None, 0.7), ("bad", "x", True, float("nan"))],
        "timestamp string, sentiment_score string, is_synthetic boolean, p_positive double",
    )
    rows = posts.normalize_scored(df).collect()
    assert rows[0].finbert_positive == 0.7 and rows[0].finbert_label == "positive" and rows[0].is_synthetic is False
    assert rows[1].timestamp is None and rows[1].sentiment_score is None and rows[1].finbert_positive is None
    assert rows[1].finbert_label == "neutral" and rows[1].is_synthetic is True


def test_cached_table_builds_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert sinks.cached_table(spark, path, build).count() == 1
    assert sinks.cached_table(spark, path, build).count() == 1 and len(calls) == 1
    assert sinks.cached_table(spark, path, build, force=True).count() == 2


def test_finalize_orders_columns(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, "hello")], "extra string, tweet_id int, tweet_text string")
    out = sinks.finalize_dataset(df, "kind")
    assert out.columns == ["tweet_id", "text", "tweet_text", "mutation_type", "is_synthetic", "extra"]
    assert out.first().mutation_type == "kind" and out.first().text == "hello"
    nested = df.withColumn("tags", F.array(F.lit("a"), F.lit('b"c')))
    sinks.write_csv(nested, str(tmp_path / "c"))
    back = spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "c")).first()
    assert back.tags == '["a","b\\"c"]'
