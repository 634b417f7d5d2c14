"""Readers of raw, scored and market tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.config import require_columns
from tiltmeter.functions.labels import label_from_score
from tiltmeter.functions.numeric import clean_double
from tiltmeter.functions.ordering import global_index

BAD_ROW = "_bad_row"


def read_posts_csv(
    spark: SparkSession, path: str | list[str], *, max_rows: int | None = None, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Posts and quarantined lines of CSV files with a header.

    Short rows are kept and padded with nulls; rows with too many fields go to the second table instead of
    vanishing. Every file is read with its own header, a column that a file lacks is null. Columns are read as text; `_source_file` and `_source_row` give a stable reading order.
    With `multi_line` a file is one task, so large inputs should be many files; without it files are split.
    """
    parts = scan_csv(spark, path, ["Date", "Content"], multi_line=multi_line)
    good = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.where("not _too_long").drop(BAD_ROW, "_too_long") for _, rows in parts])
    bad = reduce(DataFrame.unionByName, [rows.where("_too_long").select(BAD_ROW, "_source_file", "_source_row") for _, rows in parts])
    if max_rows is not None:
        good = _first_rows(good, max_rows)
    return good, bad


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first `n` rows in reading order, without moving or sorting the table.

    Splits are counted and lie wholly before the cut, wholly after it, or hold it; only the one that holds it is sorted.
    """
    so_far = Window.orderBy("_source_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = (
        rows.groupBy("_source_file").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_source_file", "_rows", F.sum("_rows").over(so_far).alias("_upto"))
    )
    whole = splits.where(F.col("_upto") <= n).select("_source_file")
    cut = splits.where((F.col("_upto") > n) & (F.col("_upto") - F.col("_rows") < n)).select(
        "_source_file", (n - F.col("_upto") + F.col("_rows")).alias("_left"),
    )
    at = F.row_number().over(Window.partitionBy("_source_file").orderBy("_source_row"))
    begun = rows.join(F.broadcast(cut), "_source_file").withColumn("_at", at).where(F.col("_at") <= F.col("_left"))
    return rows.join(whole, "_source_file", "left_semi").unionByName(begun.drop("_at", "_left"))


def scan_csv(spark: SparkSession, path: str | list[str], required: list[str], *, multi_line: bool = True) -> list[tuple[list[str], DataFrame]]:
    """(header, rows) for every header among the files: fields as text, `_too_long` for lines with too many (in `_bad_row`)."""
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}
    groups = _files_by_header(spark, path, options)
    for header in groups or [()]:
        require_columns(list(header), required)
    return [(list(header), _read_files(spark, path if len(groups) == 1 else files, list(header), options)) for header, files in groups.items()]


def _first_lines(batches: Iterator[pa.RecordBatch], quoted: bool) -> Iterator[pa.RecordBatch]:
    """(file, its first line that is not empty); null where the file system of the path is not known here."""
    for batch in batches:
        files = batch.column("file").to_pylist()
        lines: list[bytes | None] = []
        for file in files:
            try:
                system, place = (fs.LocalFileSystem(), urlsplit(file).path) if urlsplit(file).scheme in ("", "file") else fs.FileSystem.from_uri(file)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
                lines.append(None)
                continue
            with system.open_input_stream(unquote(place), compression="detect", buffer_size=1 << 16) as stream:
                lines.append(_header_of(stream, quoted))
        yield pa.record_batch({"file": pa.array(files, pa.string()), "line": pa.array(lines, pa.binary())})


def _header_of(stream: pa.NativeFile, quoted: bool) -> bytes:
    """The first line that is not empty; with `quoted`, line breaks inside quotes belong to it."""
    line = b""
    while part := stream.read(1 << 12):
        line = (line + part).lstrip(b"\r\n")
        at = next((i for i, c in enumerate(line) if c in b"\r\n" and not (quoted and line[:i].count(b'"') % 2)), None)
        if at is not None:
            return line[:at]
    return line


def _files_by_header(spark: SparkSession, path: str | list[str], options: dict) -> dict[tuple[str, ...], list[str]]:
    """Files of each header, in the order of their paths. Files without any line have none; only headers are read.

    One job reads the first lines, whatever the number of files; the parser then reads one file of each distinct line.
    Paths of file systems that only the JVM knows are read one by one.
    """
    files = sorted(spark.read.options(**options).csv(path).inputFiles())
    found = spark.createDataFrame([(file,) for file in files], "file string").mapInArrow(
        lambda batches: _first_lines(batches, bool(options["multiLine"])), "file string, line binary",
    )
    lines = {row.file: row.line for row in found.collect()} if files else {}  # as long as the list of files, which the driver holds anyway
    parsed: dict[bytes | str, tuple[str, ...]] = {}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        line = lines[file]
        key = file if line is None else bytes(line)
        if key not in parsed:
            parsed[key] = tuple(spark.read.options(**options).csv(unquote(file)).columns) if key else ()
        if parsed[key]:
            groups.setdefault(parsed[key], []).append(unquote(file))
    return groups


def _read_files(spark: SparkSession, path: str | list[str], header: list[str], options: dict) -> DataFrame:
    """Rows of files with the same header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD_ROW]])
    rows = (
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW, enforceSchema=True)
        .schema(schema).csv(path)
        .withColumns({
            "_source_file": F.concat_ws(
                "|", F.col("_metadata.file_path"), F.format_string("%020d", F.col("_metadata.file_block_start")),
            ),
            "_source_row": F.monotonically_increasing_id(),
        })
    )
    # The parser flags short rows too, so a flagged line is read once more with one field to spare.
    spare = ", ".join(f"c{i} string" for i in range(len(header) + 1))
    parsed = F.from_csv(BAD_ROW, F.lit(spare), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    # Spark refuses scans that touch the flagged line alone, hence the (always true) look at the fields.
    fields = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in header])) >= 0
    too_long = F.when(
        F.col(BAD_ROW).isNotNull(), parsed[f"c{len(header)}"].isNotNull() & fields,
    ).otherwise(F.lit(False))
    return rows.withColumn("_too_long", too_long)


PROBABILITY_ALIASES = {
    "p_positive": "finbert_positive", "p_neutral": "finbert_neutral", "p_negative": "finbert_negative",
}


def normalize_scored(df: DataFrame) -> DataFrame:
    """Typed scored posts: old column names mapped, times read, flags filled, numbers cast, label ensured."""
    for old, new in PROBABILITY_ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        df = df.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    if "is_synthetic" in df.columns:
        df = df.withColumn("is_synthetic", F.coalesce(F.col("is_synthetic").try_cast("boolean"), F.lit(False)))
    for name in (*PROBABILITY_ALIASES.values(), "sentiment_score", "sentiment_confidence"):
        if name in df.columns:
            df = df.withColumn(name, clean_double(name))
    if "finbert_label" not in df.columns:
        df = df.withColumn("finbert_label", label_from_score(F.col("sentiment_score")))
    return df


def load_steps(df: DataFrame, *tie_breakers: str) -> DataFrame:
    """Market steps with a dense `step` in time order; `tie_breakers` make that order total."""
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        df = df.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return global_index(df, ["timestamp", *(tie_breakers or ["cryptocurrency"])], "step")
