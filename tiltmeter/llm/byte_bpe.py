"""Byte-level BPE: every distinct pre-token of the corpus is encoded once, then its ids go back to its places.

1. Each task splits its texts into pre-tokens and keeps, per chunk, the distinct ones and the sequence of their
   numbers (their positions).
2. A shuffle by pre-token brings the chunks' distinct pre-tokens together; each is encoded once.
3. Ids return to their chunks and are laid out by position.
4. Decoding joins the distinct ids of some rows with the token-byte table and lays the bytes out by position. The table
   has one row per vocabulary entry, a bound that the rank file fixes, so the join needs no shuffle.

Rows stay rows: one result per input row, also for repeated ids. Null text counts as empty (no tokens). Encoding reads no
columns but the two named ones. No length limit: a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.llm.blocks import at_end, bucket_count, by_bucket, give_back, pack, ranges, runs, unpack
from tiltmeter.session import stage

CHUNK_CHARS = 28_000_000  # fewer chunks send fewer pre-tokens twice
BATCH_BYTES = 4_000_000  # results leave a task in batches of about this size


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> tiktoken.Encoding:
    """Encodes a text as one pre-token."""
    return tiktoken.Encoding("given", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={})


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table as rows (token, bytes)."""
    rows = [(rank, bytearray(token)) for token, rank in load_ranks(ranks_path).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def _split(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's texts. Texts are read one by one, and only the numbers of their pre-tokens are held."""
    find = regex.compile(pattern).findall
    chunk, held = TaskContext.get().partitionId() << 24, 0
    number: dict[str, int] = {}
    ids, parts = [], []
    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            found = find(text.as_py() or "")
            for piece in set(found).difference(number):
                number[piece] = len(number)
            ids.append(key)
            parts.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            held += 64 + sum(map(len, found))
            if held >= CHUNK_CHARS:
                yield _chunk(chunk, ids, parts, number, buckets, id_type)
                chunk, held, number, ids, parts = chunk + 1, 0, {}, [], []
    if ids:
        yield _chunk(chunk, ids, parts, number, buckets, id_type)


def _chunk(chunk: int, ids: list, parts: list[np.ndarray], number: dict[str, int], buckets: int, id_type: pa.DataType) -> pa.RecordBatch:
    pieces = [piece.encode("utf-8", "surrogatepass") for piece in number]
    index = np.concatenate(parts)
    often = np.bincount(index, minlength=len(pieces))
    grade = np.where(often > 16, 100 + 4 * np.log2(np.maximum(often, 1)), often).astype(np.int64).tolist()
    # Frequent pre-tokens get small numbers and neighbours share prefixes: both compress well.
    order = sorted(range(len(pieces)), key=lambda i: (-grade[i], pieces[i]))
    place = np.empty(len(pieces), np.uint32)
    place[order] = np.arange(len(pieces), dtype=np.uint32)
    of = np.fromiter((xxhash.xxh3_64_intdigest(pieces[i]) % buckets for i in order), np.uint64, len(pieces))
    return pa.record_batch({
        "chunk": pa.array([chunk], pa.int64()), "ids": pa.array([ids], pa.list_(id_type)),
        "counts": [pack(np.array([len(p) for p in parts], np.uint32))], "places": [pack(place[index])], "of": [pack(of)],
        "sizes": [pack(np.array([len(pieces[i]) for i in order], np.uint32))],
        "pieces": [pack(np.frombuffer(b"".join(pieces[i] for i in order), np.uint8))],
    })


def _pieces(row: dict) -> list[bytes]:
    ends, raw = np.cumsum(unpack(row["sizes"], np.uint32)).tolist(), unpack(row["pieces"], np.uint8).tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pieces = _pieces(row)
            out: dict[str, list] = {"bucket": [], "chunk": [], "sizes": [], "pieces": []}
            for bucket, at in by_bucket(unpack(row["of"], np.uint64), buckets):
                own = [pieces[i] for i in at.tolist()]
                out["bucket"].append(bucket)
                out["chunk"].append(row["chunk"])
                out["sizes"].append(pack(np.array([len(p) for p in own], np.uint32)))
                out["pieces"].append(pack(np.frombuffer(b"".join(own), np.uint8)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("sizes", pa.binary()), ("pieces", pa.binary())]))


def _encode_bucket(table: pa.Table, ranks_path: str) -> pa.Table:
    encode = _encoder(ranks_path).encode_ordinary
    known: dict[bytes, list[int]] = {}
    out: dict[str, list] = {"chunk": [], "bucket": [], "lengths": [], "tokens": []}
    for row in table.to_pylist():
        pieces = _pieces(row)
        for piece in pieces:
            if piece not in known:
                known[piece] = encode(piece.decode("utf-8"))
        coded = [known[piece] for piece in pieces]
        out["chunk"].append(row["chunk"])
        out["bucket"].append(row["bucket"])
        out["lengths"].append(pack(np.array([len(c) for c in coded], np.uint32)))
        out["tokens"].append(pack(np.array([t for c in coded for t in c], np.uint32)))
    del known
    give_back()
    return pa.Table.from_pydict(out, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("tokens", pa.binary())]))


def _assemble(chunks: pa.Table, parts: pa.Table, buckets: int, schema: pa.Schema, with_tokens: bool) -> pa.Table:
    answer = {part["bucket"]: part for part in parts.to_pylist()}
    out: dict[str, list] = {name: [] for name in schema.names}
    done: list[pa.RecordBatch] = []
    held = 0
    for row in chunks.to_pylist():
        of = unpack(row["of"], np.uint64)
        order, lengths, tokens = [], [], []
        for bucket, at in by_bucket(of, buckets):
            order.append(at)
            lengths.append(unpack(answer[bucket]["lengths"], np.uint32).astype(np.int64))
            tokens.append(unpack(answer[bucket]["tokens"], np.uint32))
        length, first, values = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), np.zeros(0, np.uint32)
        if order:
            at, sent, values = np.concatenate(order), np.concatenate(lengths), np.concatenate(tokens)
            length[at], first[at] = sent, np.cumsum(sent) - sent
        places, begin = unpack(row["places"], np.uint32), 0
        for doc, count in zip(row["ids"], unpack(row["counts"], np.uint32).tolist(), strict=True):
            own = places[begin : begin + count]
            begin += count
            ids = values[ranges(first[own], length[own])]
            out["id"].append(doc)
            out["n_tokens"].append(len(ids))
            out["ids"].append(ids.astype("<u4").tobytes())
            held += len(out["ids"][-1])
            if held >= BATCH_BYTES:
                done += _group(pa.RecordBatch.from_pydict(out, schema), "ids", with_tokens)
                out, held = {name: [] for name in schema.names}, 0
    done += _group(pa.RecordBatch.from_pydict(out, schema), "ids", with_tokens)
    give_back()
    return pa.Table.from_batches(done)


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, with_tokens: bool) -> DataFrame:
    """Encoded rows (`row`: id, n_tokens, ids), in groups behind their distinct ids (`token`) if asked for."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    buckets = bucket_count(spark)
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    layout = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(n, T.BinaryType()) for n in ("counts", "places", "of", "sizes", "pieces")),
    ])
    chunks = stage(source.mapInArrow(lambda batches: at_end(_split(batches, pattern, buckets, arrow_id)), layout), "pretokens")
    sent = chunks.select("chunk", "of", "sizes", "pieces").mapInArrow(lambda batches: _send(batches, buckets), "bucket int, chunk long, sizes binary, pieces binary")
    coded = sent.groupBy("bucket").applyInArrow(lambda table: _encode_bucket(table, ranks_path), "chunk long, bucket int, lengths binary, tokens binary")
    result = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("id", arrow_id), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    return chunks.select("chunk", "ids", "counts", "places", "of").groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(lambda left, right: _assemble(left, right, buckets, arrow, with_tokens), _grouped_type(result))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode texts -> (`id_col`, n_tokens long, ids binary: little-endian unsigned 32-bit).

    `ranks_path` is a rank file that every executor can read under that path, `pattern` its pre-token pattern.
    """
    out = _encoded(docs, ranks_path, pattern, id_col, text_col, with_tokens=False)
    return out.select(F.col("row.id").alias(id_col), "row.n_tokens", "row.ids")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`decode(encode(docs))`: the groups that decoding needs are made where the ids are, without a further pass."""
    coded = _encoded(docs, ranks_path, pattern, id_col, text_col, with_tokens=True)
    return _decoded(coded, ranks_path, "ids").withColumnRenamed("id", id_col)


def _grouped_type(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("row", row), T.StructField("token", T.IntegerType())])


def _group(rows: pa.RecordBatch, ids_col: str, with_tokens: bool = True) -> list[pa.RecordBatch]:
    """The rows, behind one row per distinct id that they hold."""
    row = rows.to_struct_array()
    out = [pa.record_batch({"row": row, "token": pa.nulls(len(row), pa.int32())})]
    if with_tokens:
        own = np.unique(np.frombuffer(b"".join(rows.column(ids_col).drop_null().to_pylist()), "<u4")).astype(np.int32)
        out.insert(0, pa.record_batch({"row": pa.nulls(len(own), row.type), "token": pa.array(own)}))
    return out


def _with_tokens(batches: Iterator[pa.RecordBatch], ids_col: str) -> Iterator[pa.RecordBatch]:
    """Rows in groups of about `BATCH_BYTES` of ids."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
        for a, b in runs(np.cumsum(sizes.astype(np.int64)) // BATCH_BYTES):
            yield from _group(batch.slice(a, b - a), ids_col)


def _laid_out(batches: Iterator[pa.RecordBatch], ids_col: str) -> Iterator[pa.RecordBatch]:
    """Bytes of the rows of each group by the joined rows before them. A join with a broadcast table keeps the order of its
    rows; an id that did not come before its rows, or that the table lacks, is an error."""
    tokens: list[np.ndarray] = []
    parts: list[pa.Array] = []
    table = _lookup(tokens, parts)
    ready = True
    for batch in batches:
        is_row = batch.column("token").is_null().to_numpy(zero_copy_only=False)
        for a, b in runs(is_row):
            piece = batch.slice(a, b - a)
            if not is_row[a]:
                if ready:
                    tokens, parts, ready = [], [], False
                tokens.append(piece.column("token").to_numpy())
                parts.append(piece.column("bytes"))
                continue
            if not ready:
                table, ready = _lookup(tokens, parts), True
            row = piece.column("row")
            columns = dict(zip([field.name for field in row.type], row.flatten(), strict=True))
            decoded = [_bytes_of(np.frombuffer(ids or b"", "<u4"), *table) for ids in columns[ids_col].to_pylist()]
            yield pa.record_batch({**columns, "decoded": pa.array(decoded, pa.binary())})


def _lookup(tokens: list[np.ndarray], parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By id: starts and sizes (-1 where there is none) in all bytes."""
    token = np.concatenate([np.zeros(0, np.int64), *tokens]).astype(np.int64)
    joined = [part.to_pylist() for part in parts]
    values = [value for part in joined for value in part]
    if None in values:
        raise ValueError(f"unknown token id {token[values.index(None)]}")
    size = np.full(token.max(initial=-1) + 1, -1, np.int64)
    size[token] = np.fromiter(map(len, values), np.int64, len(values))
    start = np.zeros(len(size), np.int64)
    start[token] = np.cumsum(size[token]) - size[token]
    return start, size, np.frombuffer(b"".join(values), np.uint8)


def _bytes_of(ids: np.ndarray, start: np.ndarray, size: np.ndarray, raw: np.ndarray) -> bytes:
    if len(ids) and (ids.max() >= len(size) or size[ids].min() < 0):
        raise ValueError("a token id without its bytes")
    return raw[ranges(start[ids], size[ids])].tobytes()


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the bytes of its ids (binary, little-endian unsigned 32-bit) in `decoded`, one row per row.

    Other columns stay as they are, but for one named `decoded`, which is replaced. Null or empty ids decode to empty
    bytes; an id that the table lacks is an error.
    """
    source = encoded.drop("decoded")
    return _decoded(source.mapInArrow(lambda batches: _with_tokens(batches, ids_col), _grouped_type(source.schema)), ranks_path, ids_col)


def _decoded(grouped: DataFrame, ranks_path: str, ids_col: str) -> DataFrame:
    joined = grouped.join(F.broadcast(token_table(grouped.sparkSession, ranks_path)), "token", "left").select("row", "token", "bytes")
    result = T.StructType([*grouped.schema["row"].dataType.fields, T.StructField("decoded", T.BinaryType())])
    return joined.mapInArrow(lambda batches: at_end(_laid_out(batches, ids_col)), result)
