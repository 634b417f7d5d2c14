"""Lookups whose keys may be very unevenly spread over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Sequence[str]) -> DataFrame:
    """Add the columns of `table` (one row per `key`) to `rows`.

    `weight` says how many rows use a key. At most HOT_SHARE keys can each hold a 1/HOT_SHARE part of the total, so
    those are broadcast and their rows need no partner in the shuffle join; they travel under a hash of their
    `spread` columns instead of the hot key. All other keys meet in an ordinary join. `table` is read three
    times, so it should be a stored one.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * HOT_SHARE >= total
    found = F.struct(*values)
    hot = table.where(is_hot).select(F.col(key), found.alias("_hot"))
    cold = table.where(~is_hot).select(F.col(key).alias("_route"), found.alias("_cold"))
    elsewhere = F.concat(F.lit("hot:"), F.xxhash64(*spread).cast("string"))
    routed = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_route", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(elsewhere),
    )
    joined = routed.join(cold, "_route", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in values])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys match each other; `left`'s keys stay."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys])
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in keys])
