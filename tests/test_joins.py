from pyspark.sql import functions as F

from conftest import plan_of
from tiltmeter.functions.joins import HOT_SHARE, lookup
from tiltmeter.session import stage


def test_lookup_is_complete_with_a_hot_key(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("key"))
    table = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    got = lookup(rows, table, "key", "n", ["id"])
    assert got.columns == ["id", "key", "first"]
    want = {}
    for r in rows.orderBy("id").collect():
        want.setdefault(r.key, r.id)
    out = got.collect()
    assert len(out) == 6000 and {r.id for r in out} == set(range(6000)) and all(r.first == want[r.key] for r in out)


def test_hot_rows_do_not_share_a_shuffle_key(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    table = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lookup(rows, table, "key", "n", ["id"])
        plan = plan_of(got)
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1500  # four partitions; the hot key alone has 2000 rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_at_most_the_bound_is_broadcast(spark):
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("key"))
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    total = table.agg(F.sum("n")).first()[0]
    assert table.where(F.col("n") * HOT_SHARE >= total).count() == 0
    assert lookup(rows, stage(table), "key", "n", ["id"]).where("first <> id OR first IS NULL").count() == 0


def test_null_keys_keep_their_rows(spark):
    from pyspark.sql import functions as F

    from tiltmeter.functions.ordering import running_sum

    rows = spark.createDataFrame([(0, "a", 1.0), (1, None, 2.0), (2, None, 3.0)], "step long, coin string, v double")
    found = running_sum(rows, "step", F.col("v"), "total", ["coin"]).orderBy("step").collect()
    assert [r.total for r in found] == [1.0, 2.0, 5.0]


def test_nested_scopes_remove_their_own_tables(spark):
    from tiltmeter.session import stage, staging_scope

    with staging_scope(spark):
        outer = stage(spark.range(3), "outer")
        with staging_scope(spark):
            stage(spark.range(2), "inner")
        assert outer.count() == 3
