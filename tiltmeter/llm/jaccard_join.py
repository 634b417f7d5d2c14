"""Documents whose n-gram sets have a Jaccard similarity of `percent` or more, as a blocked sparse product.

The incidence matrix has a row per document and a column per n-gram (64-bit hash of its words); an entry of the
product of the matrix with its transpose is the overlap of two documents. Only a small part of it can reach the bound:

1. Columns are cut into blocks of the hash space. Each block finds the n-grams that two documents or more hold and
   adds up, per document, how many of its n-grams are shared at all. The overlap with any single document is no
   larger, and it has to reach `percent` of the document's own size: other rows are discarded.
2. Equal sets are one row from here on (class); any number of copies costs one row.
3. Among class rows, columns are ordered from rare to frequent. Two rows that reach the bound share a column among the
   first `size - ceil(percent * size) + 1` of each. Rows that share one are put into a group, by stars to the smallest
   id of the column and connected components, never by pairs.
4. Within a group, rows are cut into blocks by size, and blocks whose sizes cannot reach the bound are not multiplied.
   A block product adds up overlap counts and discards pairs below the bound that their sizes give. Each product
   returns edges of a spanning forest of its links; components of these edges are the result.

Rows stay rows, also for repeated ids, which are documents of their own that share a name. Nulls, empty texts and texts
without words have no n-gram and are linked with nothing; with fewer words than n the whole sequence is the only n-gram.
A row without an id gets its component's smallest id, and null where no member has one. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.llm.blocks import at_end, bucket_count, by_bucket, chunked, mix, pack, unpack, words_of
from tiltmeter.llm.components import components
from tiltmeter.session import stage

BLOCK_ROWS = 512          # rows of a block of a group's product
BROADCAST_IDS = 1_000_000  # 8 MB
CHUNK_CHARS = 6_000_000    # sets are not merged in a chunk, so small ones cost nothing
_WORDS: dict[bytes, int] = {}  # of the running task; emptied at its end, since workers live on


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    for word in set(words).difference(_WORDS):
        _WORDS[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)]
        total += np.uint64(width)
    return np.unique(mix(total))


def _digest(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


_INCIDENCE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])
_SHARES = pa.schema([("chunk", pa.int64()), ("shared", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))])
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} " + (f"array<{_DDL[f.type.value_type]}>" if pa.types.is_list(f.type) else _DDL[f.type]) for f in schema)


def _incidence(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and block of columns: n-grams and the chunk's document numbers. Block 0 also carries the documents."""
    for chunk, rows in chunked(batches, "text", CHUNK_CHARS):
        sets = [shingle_set(row["text"], n) for row in rows]
        keys = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        at = dict(by_bucket(keys, buckets))
        out: dict[str, list] = {name: [] for name in _INCIDENCE.names}
        for bucket in range(buckets):
            if bucket and bucket not in at:
                continue
            own = at.get(bucket, np.zeros(0, np.int64))
            for name, value in (("bucket", bucket), ("chunk", chunk), ("keys", keys[own].tobytes()), ("docs", pack(docs[own]))):
                out[name].append(value)
            out["ids"].append([row["id"] for row in rows] if not bucket else None)
            out["sizes"].append([len(s) for s in sets] if not bucket else None)
            out["digests"].append([_digest(s) for s in sets] if not bucket else None)
        yield pa.RecordBatch.from_pydict(out, _INCIDENCE)
    _WORDS.clear()


def _shared(table: pa.Table) -> pa.Table:
    """Of each document in a block of columns: how many of its n-grams another document holds too."""
    rows = table.to_pylist()
    keys = [np.frombuffer(row["keys"], np.uint64) for row in rows]
    ends = np.cumsum([0, *map(len, keys)])
    joined = np.concatenate(keys)
    ordered = np.sort(joined)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    place = np.searchsorted(repeated, joined)
    found = repeated[np.minimum(place, len(repeated) - 1)] == joined if len(repeated) else np.zeros(len(joined), bool)
    shared = []
    for i, row in enumerate(rows):
        docs = unpack(row["docs"], np.uint32)
        shared.append(pack(np.bincount(docs[found[ends[i] : ends[i + 1]]]).astype(np.uint32)))
    return table.select(["chunk"]).append_column("shared", pa.array(shared, pa.binary())).append_column("ids", table["ids"]).append_column("sizes", table["sizes"]).append_column("digests", table["digests"])


def _profile(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(row for row in rows if row["ids"] is not None)
    total = np.zeros(len(head["ids"]), np.int64)
    for row in rows:
        part = unpack(row["shared"], np.uint32)
        total[: len(part)] += part
    return pa.table({"id": pa.array(head["ids"], pa.int64()), "n": pa.array(head["sizes"], pa.int64()), "digest": pa.array(head["digests"], pa.binary()), "shared": pa.array(total)})


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py() or "", n) for text in batch.column("text")]
        yield pa.record_batch({
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "digest": pa.array([_digest(s) for s in sets], pa.binary()), "keys": pa.array([s.tobytes() for s in sets], pa.binary()),
        })
    _WORDS.clear()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["keys"], np.int64)
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield pa.record_batch({"tag": pa.array(np.full(len(part), row["tag"])), "n": pa.array(np.full(len(part), row["n"])), "key": pa.array(part)})


def _links(table: pa.Table, percent: int) -> pa.Table:
    """Product of the rows of one or two blocks: overlap counts, then a spanning forest of the links, and for every row
    how many documents it links with here."""
    rows = sorted(table.select(["tag", "n", "copies", "side", "keys"]).to_pylist(), key=lambda r: (r["n"], r["tag"]))
    ids, sizes, copies, side = (np.array([r[c] for r in rows], np.int64) for c in ("tag", "n", "copies", "side"))
    entries = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r["keys"]) // 8 for r in rows])
    _, column = np.unique(entries, return_inverse=True)
    order = np.argsort(column, kind="stable")
    begin = np.searchsorted(column[order], np.arange(column.max() + 2))
    posting, first = owner[order], np.searchsorted(owner, np.arange(len(rows) + 1))
    root, found = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    edges: list[tuple[int, int]] = []
    for i in range(len(rows)):
        own = column[first[i] : first[i + 1]]
        own = own[begin[own + 1] - begin[own] > 1]
        last = np.searchsorted(sizes, sizes[i] * 100 // percent, "right")  # sizes beyond cannot reach the bound
        lists = [posting[begin[c] : begin[c + 1]] for c in own.tolist()]
        if not lists or last <= i + 1:
            continue
        overlap = np.bincount(np.concatenate(lists), minlength=len(rows))[i + 1 : last]
        linked = i + 1 + np.flatnonzero(100 * overlap >= percent * (sizes[i] + sizes[i + 1 : last] - overlap))
        linked = linked[(side[linked] != side[i]) | (side[i] == 0)]
        found[i] += copies[linked].sum()
        found[linked] += copies[i]
        for j in linked[root[linked] != root[i]].tolist():
            if root[j] != root[i]:
                edges.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    some = np.flatnonzero(found)
    return pa.table({
        "a": pa.array([*(a for a, _ in edges), *ids[some].tolist()], pa.int64()),
        "b": pa.array([*(b for _, b in edges), *[None] * len(some)], pa.int64()),
        "links": pa.array([*[None] * len(edges), *found[some].tolist()], pa.int64()),
    })


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """-> (`id_col` long, n_shingles long, component_id long, n_links long), one per row.

    component_id is the smallest id reachable, n_links the number of other rows linked directly, copies included.
    """
    buckets = bucket_count(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cells = source.mapInArrow(lambda b: at_end(_incidence(b, n, buckets)), _ddl(_INCIDENCE))
    shares = cells.groupBy("bucket").applyInArrow(_shared, _ddl(_SHARES))
    profile = stage(shares.groupBy("chunk").applyInArrow(_profile, "id long, n long, digest binary, shared long"), "profile")

    tag = F.xxhash64("digest")  # names a class; as good as an n-gram's hash
    near = profile.where(F.expr(f"n > 0 and 100 * shared >= {percent} * n"))
    classes = stage(near.groupBy(tag.alias("tag")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    sets = _rows_of(source, classes).mapInArrow(lambda b: at_end(_sets(b, n)), "n long, digest binary, keys binary")
    sets = sets.select(tag.alias("tag"), "n", "keys").join(classes.select("tag", "copies"), "tag")
    sets = stage(sets.dropDuplicates(["tag"]), "sets")

    held = stage(sets.select("tag", "n", "keys").mapInArrow(lambda b: at_end(_explode(b)), "tag long, n long, key long"), "cells")
    frequent = held.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # N-grams of one row alone come first in the order from rare to frequent, and match nothing: what they leave of the
    # prefix goes to the rarest of the others.
    own = Window.partitionBy("tag")
    ranked = held.join(frequent, "key").withColumn("place", F.row_number().over(own.orderBy("df", "key"))).withColumn("common", F.count("*").over(own))
    prefix = stage(ranked.where(F.expr(f"place <= common - (({percent} * n + 99) div 100) + 1")).select("tag", "key"), "prefix")
    star = prefix.groupBy("key").agg(F.min("tag").alias("low"))
    edges = prefix.join(star, "key").where("tag <> low").select(F.col("tag").alias("a"), F.col("low").alias("b")).distinct()
    group = components(edges)

    tasks = _block_tasks(stage(sets.join(group.withColumnRenamed("node", "tag"), "tag"), "members"), percent)
    links = tasks.groupBy("component", "c1", "b1", "c2", "b2").applyInArrow(lambda t: _links(t, percent), "a long, b long, links long")
    links = stage(links, "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("tag")).agg(F.sum("links").alias("links"))
    named = classes.join(components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "tag"), "tag", "left").withColumn("component", F.coalesce("component", "tag"))
    named = named.groupBy("component").agg(F.min("rep").alias("low")).join(named.select("tag", "component", "copies"), "component")
    named = named.join(counts, "tag", "left").select("tag", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = profile.withColumn("tag", tag).join(named, "tag", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _rows_of(source: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts of one row per class, and of all rows without an id if a class has no other.

    The ids are broadcast up to `BROADCAST_IDS` of them, and shuffled beyond.
    """
    wanted = classes.where("rep is not null").select(F.col("rep").alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = source.join(wanted, "id", "left_semi").select("text")
    return rows if classes.where("rep is null").isEmpty() else rows.unionAll(source.where("id is null").select("text"))


def _block_tasks(rows: DataFrame, percent: int) -> DataFrame:
    """Rows copied to the block products they take part in. Sizes of linked rows differ by one size class at most."""
    ratio = math.log(100 / percent * 1.01)
    rows = rows.withColumn("c", F.floor(F.log("n") / F.lit(ratio)).cast("int"))
    sizes = stage(rows.groupBy("component", "c").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"), F.count("*").alias("members")), "sizes")
    whole = sizes.groupBy("component").agg(F.sum("members").alias("all"))
    near = sizes.select("component", F.col("c").alias("c0"), "blocks")
    for name, shift in (("below", 1), ("above", -1)):
        sizes = sizes.join(near.select("component", (F.col("c0") + shift).alias("c"), F.col("blocks").alias(name)), ["component", "c"], "left")
    rows = rows.join(sizes.join(whole, "component"), ["component", "c"])
    rows = rows.withColumn("b", F.expr("cast(pmod(xxhash64(tag), blocks) as int)"))
    span = "transform(sequence(0, {n} - 1), j -> named_struct({s}))"
    own = span.format(n="blocks", s="'c1', c, 'b1', least(b, j), 'c2', c, 'b2', greatest(b, j), 'side', if(j = b, 0, if(b < j, 1, 2))")
    above = span.format(n="above", s="'c1', c, 'b1', b, 'c2', c + 1, 'b2', j, 'side', 1")
    below = span.format(n="below", s="'c1', c - 1, 'b1', j, 'c2', c, 'b2', b, 'side', 2")
    single = "array(named_struct('c1', -1, 'b1', 0, 'c2', -1, 'b2', 0, 'side', 0))"
    part = f"if(all <= {BLOCK_ROWS}, {single}, concat({own}, if(above is null, array(), {above}), if(below is null, array(), {below})))"
    return rows.select("component", "tag", "n", "copies", "keys", F.explode(F.expr(part)).alias("t")).select("component", "tag", "n", "copies", "keys", "t.*")
