"""Scores of texts, kept between runs: a text is scored once, whichever run meets it first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.schemas import SCORES
from tiltmeter.sources.versions import VersionedTable

STORED = T.StructType([
    T.StructField("text_md5", T.StringType()), *SCORES.fields, T.StructField("score_batch", T.LongType()), T.StructField("prefix", T.StringType()),
])


class ScoreStore:
    """Scores by text digest in batches, one folder per digest prefix, so a lookup of some texts reads their prefixes only.

    One store belongs to one scorer. `score_batch` is the version that brought a score. The prefix has `digits` hex digits,
    which makes 16 ** `digits` folders: few for small stores, 256 by default.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.table, self.digits = VersionedTable(spark, path, STORED, ["prefix"]), digits

    def prefix(self) -> Column:
        return F.substring("text_md5", 1, self.digits)

    def latest(self) -> int:
        return self.table.latest()

    def read(self, version: int | None = None, prefixes: Sequence[str] | None = None) -> DataFrame:
        rows = self.table.read(version)
        return rows if prefixes is None else rows.where(F.col("prefix").isin(list(prefixes)))

    def add(self, scored: DataFrame, since: int) -> int:
        """Add scores (text_md5, score columns) that version `since` lacks."""
        rows = scored.withColumns({"score_batch": F.lit(since + 1).cast("long"), "prefix": self.prefix()})
        # By ranges of the digest, a task writes few prefixes and a large batch is many tasks.
        return self.table.append(
            rows.repartitionByRange("text_md5"), since, lambda mine, theirs: mine.join(theirs.select("text_md5"), "text_md5", "left_anti"),
        )

    def compact(self) -> bool:
        """All batches as one; False if another run has committed meanwhile."""
        since = self.latest()
        return bool(since) and self.table.replace(self.table.read(since).repartitionByRange("text_md5"), since)
