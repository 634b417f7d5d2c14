"""Typed ingestion: every input row comes out once, as a good row or as a rejected one with its reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.numeric import clean_double
from tiltmeter.functions.text import HAS_TEXT
from tiltmeter.schemas import MARKET_STEP
from tiltmeter.session import stage
from tiltmeter.sources.posts import BAD_ROW, load_steps, scan_csv

# Tried in this order, after the forms that a cast reads.
TIME_FORMS = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "MMM d, yyyy h:mm a", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")


def read_time(col: Column, forms: Sequence[str] = TIME_FORMS) -> Column:
    """First reading of a time that any of the forms gives; null if none does."""
    text = F.trim(col.cast("string"))
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(form)) for form in forms])


def _halves(tagged: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Write the tagged rows once, split by verdict; the halves are two folders of that table."""
    table = stage(tagged.withColumn("accepted", F.col("reason").isNull()), name, by=["accepted"])
    return table.where("accepted").drop("accepted", "reason"), table.where("not accepted").drop("accepted")


def ingest_posts(spark: SparkSession, path: str | list[str], forms: Sequence[str] = TIME_FORMS, **options: bool) -> tuple[DataFrame, DataFrame]:
    """Posts of CSV files with their time read as `Date`, and all other rows with `reason`; the files are read once.

    Reasons, the first that holds: `too many fields`, `unreadable time`, `empty text`. Rejected rows keep their fields as
    text; of rows with too many fields the line is in `_bad_row`.
    """
    parts = [rows for _, rows in scan_csv(spark, path, ["Date", "Content"], **options)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    time = read_time(F.col("Date"), forms)
    reason = (
        F.when(F.col("_too_long"), "too many fields").when(time.isNull(), "unreadable time")
        .when(~F.coalesce(F.col("Content"), F.lit("")).rlike(HAS_TEXT), "empty text")
    )
    good, rejected = _halves(rows.withColumns({"_time": time, "reason": reason, BAD_ROW: F.when(F.col("_too_long"), F.col(BAD_ROW))}).drop("_too_long"), "posts")
    return good.withColumn("Date", F.col("_time")).drop("_time", BAD_ROW), rejected.drop("_time")


def read_market_steps(
    spark: SparkSession, path: str | list[str], order: T.StructType = T.StructType([]), forms: Sequence[str] = TIME_FORMS, **options: bool,
) -> tuple[DataFrame, DataFrame]:
    """Market steps of CSV files in the declared schema, numbered in time order, and all rejected rows with `reason`.

    A field that is not of its type (`bad <field>`), a time that no form reads and too many fields reject a row; empty
    fields are null. `order` names further typed columns that settle equal times; rows that stay equal in (time,
    symbol, `order`) have no order, which is an error: steps would change from run to run.
    """
    fields = [f for f in MARKET_STEP.fields if f.name != "timestamp"] + list(order.fields)
    parts = [rows for _, rows in scan_csv(spark, path, ["timestamp", "cryptocurrency", *order.names], **options)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def raw(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit("")) if name in rows.columns else F.lit(None).cast("string")

    def typed(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DoubleType):
            number = clean_double(raw(field.name))
            return F.when(F.abs(number) < F.lit(float("inf")), number)
        return raw(field.name).try_cast(field.dataType)

    time = read_time(F.col("timestamp"), forms)
    reason = F.when(F.col("_too_long"), "too many fields").when(time.isNull(), "unreadable time")
    for field in fields:
        reason = reason.when(raw(field.name).isNotNull() & typed(field).isNull(), f"bad {field.name}")
    reason = reason.when(raw("cryptocurrency").isNull(), "bad cryptocurrency")
    for name in order.names:
        reason = reason.when(raw(name).isNull(), f"bad {name}")
    line = F.coalesce(F.when(F.col("_too_long"), F.col(BAD_ROW)), F.to_json(F.struct("timestamp", *[F.col(f.name) for f in fields if f.name in rows.columns])))
    tagged = rows.select(time.alias("timestamp"), *[typed(f).alias(f.name) for f in fields], reason.alias("reason"), line.alias("line"), "_source_file", "_source_row")
    good, rejected = _halves(tagged, "market")
    keys = ["timestamp", "cryptocurrency", *order.names]
    tied = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if tied:
        raise ValueError(f"steps have no total order by {', '.join(keys)}: {[tuple(row[k] for k in keys) for row in tied]}")
    return load_steps(good.drop("line", "_source_file", "_source_row"), *keys[1:]), rejected.select("reason", "line", "_source_file", "_source_row")


