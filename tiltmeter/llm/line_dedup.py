"""Line deduplication behind two Bloom filters, one of keys seen once and one of keys seen twice.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at its ends, A-Z in lower case. A key repeats if at least
`min_docs` documents hold it (copies inside one document count once).

1. A task keeps its documents in chunks and, per chunk, a digest of every distinct key, with the number of documents.
2. The key space is cut into buckets of about BUCKET_KEYS keys, each with a filter pair of its own, so the filters grow with
   the data and are never collected or broadcast. A chunk sends every bucket its digests' 32-bit values, sorted and packed.
   The bucket's task sets the filters chunk by chunk: what `once` already holds, or what a chunk holds in two documents,
   enters `twice`; each chunk then gets one bit per value it sent. Filters have SLOTS slots a value and two probes: about
   1 % of single keys are suspected wrongly, no repeat is ever missed.
3. Only suspects shuffle, by the whole 128-bit digest, one row per chunk and key: their documents are counted exactly and
   the first occurrence (smallest id, null ids last; then chunk, row and line) is chosen. A very common line costs one
   row per chunk, and its count is combined before the shuffle.
4. Confirmed keys go back to their chunks, which write the remaining lines.

`keep="first"` leaves the first occurrence of a repeated key in place, `keep="none"` drops all of them. A null or empty text
is one empty line; it has no key of `min_chars` code points and stays. Rows are documents, also with equal or null ids.
Texts are read whole; a text longer than a chunk is a chunk of its own. Empty tables give empty results. Input columns
other than the id, the text and those in `keep_columns` are not read, so clashing names do no harm. Rows sent are at most
chunks x buckets, and never more than distinct keys per chunk: only buckets that a chunk has keys for get a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tiltmeter.llm.blocks import at_end, bucket_count, give_back, mix, pack, runs, unpack
from tiltmeter.session import stage

CHUNK_CHARS = 24_000_000
BUCKET_KEYS = 1 << 20
SLOTS = 16

PACKED = ("sizes", "texts", "digests", "lines", "docs", "first")


def line_keys(text: str | None) -> list[bytes]:
    """Keys of a text's lines: bytes know just the white space and the letters that the definition names."""
    return [line.strip().lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _code_points(key: bytes) -> int:
    return len(key) - sum(0x80 <= b < 0xC0 for b in key)


def _chunks(batches: Iterator[pa.RecordBatch], min_chars: int, schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    chunk, held = TaskContext.get().partitionId() << 24, 0
    rows: list[pa.StructArray] = []
    texts: list[str] = []
    for batch in batches:
        start = 0
        for at, text in enumerate(batch.column("text")):
            texts.append(text.as_py() or "")
            held += len(texts[-1]) + 64
            if held >= limit:
                yield _chunk(chunk, [*rows, batch.column("row").slice(start, at + 1 - start)], texts, min_chars, schema)
                chunk, held, rows, texts, start = chunk + 1, 0, [], [], at + 1
        if start < batch.num_rows:
            rows.append(batch.column("row").slice(start))
    if texts:
        yield _chunk(chunk, rows, texts, min_chars, schema)


def _chunk(chunk: int, rows: list[pa.StructArray], texts: list[str], min_chars: int, schema: pa.Schema) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    parts = []
    for text in texts:
        keys = line_keys(text)
        for key in keys:
            if key not in number:
                number[key] = len(number)
        parts.append(np.fromiter(map(number.__getitem__, keys), np.int64, len(keys)))
    all_rows = pa.concat_arrays([pa.array(r) if not isinstance(r, pa.Array) else r for r in rows])
    # Keys that are too short are no keys: they keep a number, but nothing of them is sent.
    long_enough = np.fromiter((_code_points(k) >= min_chars for k in number) if min_chars > 1 else map(bool, number) if min_chars else (True for _ in number), bool, len(number))
    place = np.where(long_enough, np.cumsum(long_enough) - 1, -1)
    lines = place[np.concatenate(parts)]
    counts = np.array([len(p) for p in parts], np.int64)
    total = int(long_enough.sum())
    of_doc, of_line = np.repeat(np.arange(len(parts)), counts), np.concatenate([np.arange(n) for n in counts])
    real = lines >= 0
    pairs = np.unique(of_doc[real] * max(total, 1) + lines[real])
    ids = all_rows.field("id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, i))
    rank = np.empty(len(ids), np.uint64)
    rank[order] = np.arange(len(ids), dtype=np.uint64)
    first = np.full(total, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(first, lines[real], (rank[of_doc[real]] << np.uint64(32)) | of_line[real].astype(np.uint64))
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    digests = b"".join(xxhash.xxh3_128_digest(k) for k, good in zip(number, long_enough.tolist(), strict=True) if good)
    packed = {
        "sizes": pack(np.array([len(t) for t in encoded], np.int64)), "texts": zstandard.ZstdCompressor(level=3).compress(b"".join(encoded)),
        "digests": digests, "lines": pack(lines.astype(np.int32)), "docs": pack(np.bincount(pairs % max(total, 1), minlength=total)[:total].astype(np.uint32)), "first": pack(first),
    }
    columns = [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays([0, len(all_rows)], all_rows), pa.array([total], pa.int64()), *(pa.array([packed[name]], pa.binary()) for name in PACKED)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _routed(digests: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, value) of a chunk's keys, sorted by bucket and value; sender and receiver agree on it."""
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    bucket, value = (halves[:, 0] % np.uint64(buckets)).astype(np.int64), halves[:, 1] >> np.uint64(32)
    order = np.lexsort((value, bucket))
    return order, bucket[order], value[order].astype(np.uint32)


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            order, bucket, value = _routed(row["digests"], buckets)
            again = (unpack(row["docs"], np.uint32) > 1)[order]
            out: dict[str, list] = {"bucket": [], "chunk": [], "n": [], "steps": [], "again": []}
            for a, b in runs(bucket):
                out["bucket"].append(int(bucket[a]))
                out["chunk"].append(row["chunk"])
                out["n"].append(b - a)
                out["steps"].append(pack(np.diff(value[a:b], prepend=np.uint32(0))))
                out["again"].append(pack(np.packbits(again[a:b])))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("steps", pa.binary()), ("again", pa.binary())]))


class FilterPair:
    """Two Bloom filters over 32-bit values: seen once, seen twice."""

    def __init__(self, values: int):
        self.mask = np.uint64((1 << max(10, (SLOTS * values - 1).bit_length())) - 1)
        self.once, self.twice = np.zeros(int(self.mask) + 1, bool), np.zeros(int(self.mask) + 1, bool)

    def probes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return spread & self.mask, (spread >> np.uint64(32)) & self.mask

    def add(self, values: np.ndarray, again: np.ndarray) -> None:
        a, b = self.probes(values)
        seen = (self.once[a] & self.once[b]) | again
        self.twice[a[seen]] = self.twice[b[seen]] = True
        self.once[a] = self.once[b] = True

    def suspected(self, values: np.ndarray) -> np.ndarray:
        a, b = self.probes(values)
        return self.twice[a] & self.twice[b]


def _filter_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in batch.to_pylist()]  # packed: some bytes a key
    pair = FilterPair(sum(row["n"] for row in rows))

    def values(row: dict) -> np.ndarray:
        return np.cumsum(unpack(row["steps"], np.uint32), dtype=np.uint32)

    for row in rows:
        pair.add(values(row), np.unpackbits(unpack(row["again"], np.uint8), count=row["n"]).astype(bool))
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
    for at in range(0, len(rows), 1024):
        some = rows[at : at + 1024]
        yield pa.RecordBatch.from_pydict({
            "chunk": [r["chunk"] for r in some], "bucket": [r["bucket"] for r in some], "bits": [pack(np.packbits(pair.suspected(values(r)))) for r in some],
        }, schema)


def _suspects(chunks: pa.Table, answers: pa.Table, buckets: int, schema: pa.Schema) -> pa.Table:
    bits = {row["bucket"]: row["bits"] for row in answers.to_pylist()}
    out = []
    for row in chunks.to_pylist():
        order, bucket, _ = _routed(row["digests"], buckets)
        if not len(order):
            continue
        flags = [np.unpackbits(unpack(bits[int(bucket[a])], np.uint8), count=b - a) for a, b in runs(bucket)]
        at = np.sort(order[np.concatenate(flags).astype(bool)])
        docs, first = unpack(row["docs"], np.uint32)[at], unpack(row["first"], np.uint64)[at]
        ids = [r["id"] for r in row["rows"]]
        by_rank = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, i))
        which = np.array(by_rank, np.int64)[(first >> np.uint64(32)).astype(np.int64)] if len(at) else np.zeros(0, np.int64)
        raw = row["digests"]
        out.append(pa.Table.from_pydict({
            "digest": [raw[16 * i : 16 * i + 16] for i in at.tolist()], "chunk": np.full(len(at), row["chunk"]), "place": at, "n": docs.astype(np.int64),
            "first_id": [ids[i] for i in which.tolist()], "first_row": which, "first_line": (first & np.uint64(0xFFFFFFFF)).astype(np.int64),
        }, schema))
    give_back()
    return pa.concat_tables(out) if out else schema.empty_table()


def _write(chunks: pa.Table, drops: pa.Table, schema: pa.Schema) -> pa.Table:
    places, rows_, lines_ = (drops.column(c).to_numpy(zero_copy_only=False) for c in ("place", "keep_row", "keep_line"))
    out = []
    for at in range(chunks.num_rows):
        row = {name: chunks.column(name)[at].as_py() for name in ("sizes", "texts", "lines")}
        line_place = unpack(row["lines"], np.int32)
        gone = np.zeros(int(line_place.max(initial=-1)) + 2, bool)  # the last slot stands for lines without a key
        gone[places] = True
        stays = {(r, n) for r, n in zip(rows_.tolist(), lines_.tolist(), strict=True) if r >= 0}
        drop = gone[line_place]
        sizes = unpack(row["sizes"], np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["texts"])
        kept, n_lines, n_dropped, begin, line = [], [], [], 0, 0
        for doc, size in enumerate(sizes.tolist()):
            text = raw[begin : begin + size]
            begin += size
            count = text.count(b"\n") + 1
            own = drop[line : line + count]
            line += count
            dropped = int(own.sum())
            if dropped:
                parts = text.split(b"\n")
                flags = own.tolist()
                if stays:
                    flags = [f and (doc, k) not in stays for k, f in enumerate(flags)]
                    dropped = sum(flags)
                text = b"\n".join(p for p, f in zip(parts, flags, strict=True) if not f)
            kept.append(text)
            n_lines.append(count)
            n_dropped.append(dropped)
        own_rows = chunks.column("rows").combine_chunks().slice(at, 1).flatten()
        fields = {own_rows.type.field(i).name: own_rows.field(i) for i in range(own_rows.type.num_fields)}
        fields |= {"kept_text": pa.array(kept, pa.binary()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        out.append(pa.Table.from_arrays([fields[f.name].cast(f.type) for f in schema], schema=schema))
    give_back()
    return pa.concat_tables(out) if out else schema.empty_table()


def dedup_lines(
    docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", keep_columns: Sequence[str] = (),
) -> DataFrame:
    """Documents without repeated lines -> (`id_col`, `keep_columns`, n_lines, n_dropped, kept_text)."""
    if keep not in ("first", "none") or min_docs < 2:
        raise ValueError("keep is 'first' or 'none', min_docs at least 2")
    spark = docs.sparkSession
    row = F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep_columns)])
    source = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    row_type = source.schema["row"].dataType
    layout = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(row_type)), T.StructField("n_keys", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in PACKED),
    ])
    arrow, limit = to_arrow_schema(layout), CHUNK_CHARS
    chunks = stage(source.mapInArrow(lambda batches: at_end(_chunks(batches, min_chars, arrow, limit)), layout), "line-chunks")

    keys = chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    buckets = max(1, -(-keys // BUCKET_KEYS), min(bucket_count(spark), keys >> 12))
    sent = chunks.select("chunk", "digests", "docs").mapInArrow(lambda batches: _send(batches, buckets), "bucket long, chunk long, n long, steps binary, again binary")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return at_end(_filter_bucket(batches))

    answers = sent.groupBy("bucket").applyInArrow(filtered, "chunk long, bucket long, bits binary")
    id_type = row_type["id"].dataType
    found = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("chunk", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("first_id", id_type), T.StructField("first_row", T.LongType()), T.StructField("first_line", T.LongType()),
    ])
    found_arrow = to_arrow_schema(found)
    heads = chunks.select("chunk", "rows", "digests", "docs", "first")
    suspects = stage(heads.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda left, right: _suspects(left, right, buckets, found_arrow), found), "suspects")

    first = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", F.col("chunk").alias("first_chunk"), "first_row", "first_line")
    confirmed = suspects.groupBy("digest").agg(F.sum("n").alias("docs"), F.min(first).alias("choice")).where(F.col("docs") >= min_docs).drop("docs")
    here = (F.col("choice.first_chunk") == F.col("chunk")) & F.lit(keep == "first")
    drops = suspects.select("digest", "chunk", "place").join(confirmed, "digest").select(
        "chunk", "place", F.when(here, F.col("choice.first_row")).otherwise(-1).alias("keep_row"), F.when(here, F.col("choice.first_line")).otherwise(-1).alias("keep_line"),
    )
    result = T.StructType([*row_type.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.BinaryType())])
    result_arrow = to_arrow_schema(result)
    out = chunks.select("chunk", "rows", "sizes", "texts", "lines").groupBy("chunk").cogroup(drops.groupBy("chunk")).applyInArrow(lambda left, right: _write(left, right, result_arrow), result)
    return out.select(F.col("id").alias(id_col), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep_columns)], "n_lines", "n_dropped", F.decode("kept_text", "UTF-8").alias("kept_text"))
