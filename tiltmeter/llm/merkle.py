"""Merkle dataset manifest: one hash tree per part of a dataset, one tree over the parts' roots, stored as subtrees.

1. Every row becomes a leaf, the digest of its fields; a leaf's place is its rank in its part (`rows_in_order`).
2. Places are cut into aligned subtrees of 2^HEIGHT leaves. A subtree is one row of the manifest: the digests of all its
   nodes in van Emde Boas order, that is, the tree is split at half its height, the top half is stored first and then
   every bottom subtree, each of them laid out the same way. `addresses` computes where a node lies, without pointers;
   any path from a leaf to the root touches few runs of the stored bytes, whatever the size of a cache or page.
3. The roots of the subtrees are the leaves of the next level, until a part has one subtree; the parts' roots are the
   leaves of the top tree. A level has 2^-HEIGHT of the rows of the level below.
4. Proofs come down the same way: the siblings inside a subtree, then those of the subtree's root, read by address.

Two neighbours become the digest of their concatenated hex digests; the last node of an odd level is hashed alone. Null
fields are written `-`, all others as UTF-8 length, `:` and value, so no two rows share an encoding. Null parts are a
part of their own, the first; null ids come first in their part; rows with the same id stand by digest, so equal rows are
leaves of their own with the same digest. An empty table has no root and no rows. Other columns are not read, unless named
in `keep`. No task holds more than some subtrees: a part that holds a third of all rows is as many subtrees as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tiltmeter.functions.ordering import global_index, grouped_index
from tiltmeter.session import stage

HEIGHT = 10  # of a stored subtree: 1024 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """Digest of a row's fields, nulls told apart from any value."""
    def shown(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(shown, fields)), 256)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Van Emde Boas addresses of the nodes `index` at `depth` of a complete binary tree with `levels` levels."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, index)
    bottom, below = levels - top, depth - top
    start = (1 << top) - 1 + (index >> below) * ((1 << bottom) - 1)
    return start + addresses(bottom, below, index & ((1 << below) - 1))


def levels_of(n: int, height: int) -> int:
    """Levels of a subtree in a part with n nodes: all of them, or just those that the part needs."""
    return min(height, max(n - 1, 0).bit_length()) + 1


def subtree(leaves: Sequence[str], levels: int) -> tuple[bytes, str]:
    """(digests of all nodes in van Emde Boas order, hex digest of the root); missing nodes are zeros."""
    slots = np.zeros(((1 << levels) - 1, 32), np.uint8)
    nodes = list(leaves)
    for depth in range(levels - 1, -1, -1):
        at = addresses(levels, depth, np.arange(len(nodes), dtype=np.int64))
        slots[at] = np.frombuffer(bytes.fromhex("".join(nodes)), np.uint8).reshape(-1, 32)
        if depth:
            nodes = [hashlib.sha256("".join(nodes[k : k + 2]).encode()).hexdigest() for k in range(0, len(nodes), 2)]
    return slots.tobytes(), nodes[0]


def siblings(tree: bytes, leaves: int, levels: int) -> list[list[str]]:
    """For every leaf its siblings from below: side (`L` or `R`) and hex digest, empty where a node stands alone."""
    text, paths = tree.hex(), [[] for _ in range(leaves)]
    index, count = np.arange(leaves, dtype=np.int64), leaves
    for depth in range(levels - 1, 0, -1):
        other = index ^ 1
        at = addresses(levels, depth, other) * 64
        for path, start, alone, right in zip(paths, at.tolist(), (other >= count).tolist(), (other > index).tolist(), strict=True):
            path.append("" if alone else ("R" if right else "L") + text[start : start + 64])
        index, count = index >> 1, (count + 1) >> 1
    return paths


def _build(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("rows")
        leaves = iter(rows.flatten().field("leaf").to_pylist())
        made = [subtree(list(islice(leaves, size)), levels_of(n, height)) for size, n in zip(pc.list_value_length(rows).to_pylist(), batch.column("n").to_pylist(), strict=True)]
        yield batch.append_column("tree", pa.array([m[0] for m in made], pa.binary())).append_column("root", pa.array([m[1] for m in made], pa.string()))


def _prove(batches: Iterator[pa.RecordBatch], height: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("rows")
        for at, (size, n, tree, above) in enumerate(zip(pc.list_value_length(rows).to_pylist(), batch.column("n").to_pylist(), batch.column("tree").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            own = rows.slice(at, 1).flatten()
            columns = {name: pa.repeat(batch.column(name)[at], size) for name in ("nr", "subroot")}
            columns["path"] = pa.array([path + above for path in siblings(tree, size, levels_of(n, height))], pa.list_(pa.string()))
            fields = {own.type.field(i).name: own.field(i) for i in range(own.type.num_fields)}
            yield pa.RecordBatch.from_arrays([(columns | fields)[name].cast(schema.field(name).type) for name in schema.names], schema=schema)


def _tree(nodes: DataFrame, height: int, keep: Sequence[str] = ()) -> list[DataFrame]:
    """(nr, n, pos, leaf, `keep`): place `pos` of `n` in part `nr` -> written subtrees, level by level."""
    block = 1 << height
    levels: list[DataFrame] = []
    while True:
        rows = F.sort_array(F.collect_list(F.struct("pos", "leaf", *keep)))  # at most `block` of them
        grouped = nodes.groupBy("nr", "n", F.floor(F.col("pos") / block).cast("long").alias("block")).agg(rows.alias("rows"))
        schema = T.StructType([*grouped.schema.fields, T.StructField("tree", T.BinaryType()), T.StructField("root", T.StringType())])
        blocks = stage(grouped.mapInArrow(lambda batches: _build(batches, height), schema), "subtrees")
        levels.append(blocks)
        nodes, keep = blocks.where(F.col("n") > block).select("nr", F.ceil(F.col("n") / block).cast("long").alias("n"), F.col("block").alias("pos"), F.col("root").alias("leaf")), ()
        if nodes.isEmpty():
            return levels


def _paths(levels: Sequence[DataFrame], height: int, above: DataFrame | str | None) -> DataFrame:
    """Siblings of every leaf up to the last root.

    `above` (nr, subroot, path) continues the path of every part; of the top tree it is the root, where paths end.
    """
    found: DataFrame | None = None
    for blocks in reversed(levels):
        whole = blocks.where(F.col("n") <= 1 << height)
        ends = whole.join(above, "nr") if isinstance(above, DataFrame) else whole.withColumns({
            "subroot": F.lit(above).cast("string"), "path": F.array().cast("array<string>"),
        })
        if found is not None:
            upper = found.select("nr", F.col("pos").alias("block"), "subroot", "path")
            ends = ends.unionByName(blocks.where(F.col("n") > 1 << height).join(upper, ["nr", "block"]).select(*ends.columns))
        inner = blocks.schema["rows"].dataType.elementType
        names = [T.StructField("nr", T.LongType()), T.StructField("subroot", T.StringType()), T.StructField("path", T.ArrayType(T.StringType()))]
        schema = T.StructType([*names, *inner.fields])
        arrow = to_arrow_schema(schema)
        found = ends.select("nr", "subroot", "n", "rows", "tree", "path").mapInArrow(lambda batches, arrow=arrow: _prove(batches, height, arrow), schema)
    return found


@dataclass(frozen=True)
class Manifest:
    """Written tables of a manifest."""

    parts: DataFrame          # part, nr (its place), n (its rows), subroot
    levels: list[DataFrame]   # subtrees of all parts: nr, n, block, rows, tree, root; leaves first, then roots of subtrees
    top: list[DataFrame]      # the same over the parts' roots
    root: str | None
    height: int               # of a stored subtree

    def proofs(self) -> DataFrame:
        """Every leaf with its part's root and its siblings up to the root: nr, subroot, path, pos, leaf, kept columns."""
        above = _paths(self.top, self.height, self.root).select(F.col("pos").alias("nr"), F.col("leaf").alias("subroot"), "path")
        return _paths(self.levels, self.height, above)


def build(rows: DataFrame, part: str, order: str, leaf: str, keep: Sequence[str] = (), height: int = HEIGHT) -> Manifest:
    """Manifest of `rows`: a tree per value of `part` over the digests `leaf`, by `order`, and one over the trees' roots."""
    named = rows.select(F.col(part).alias("part"), F.col(order).alias("at"), F.col(leaf).alias("leaf"), *[F.col(c).alias(c) for c in keep])
    placed = stage(grouped_index(named, ["part"], [F.col("at").asc_nulls_first(), "leaf"], "pos"), "leaves")
    sizes = stage(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "parts")
    parts = stage(global_index(sizes, [F.col("part").asc_nulls_first()], "nr").select("part", F.col("nr").cast("long").alias("nr"), "n"), "parts")
    named_part = parts.withColumnRenamed("part", "_part")
    nodes = placed.join(named_part, F.col("part").eqNullSafe(F.col("_part"))).select("nr", "n", "pos", "leaf", *keep)
    levels = _tree(nodes, height, keep)
    roots = levels[0].where(F.col("n") <= 1 << height).select("nr", "root")
    for blocks in levels[1:]:
        roots = roots.unionByName(blocks.where(F.col("n") <= 1 << height).select("nr", "root"))
    roots = stage(roots, "subroots")
    top = _tree(roots.select(F.lit(0).cast("long").alias("nr"), F.lit(roots.count()).cast("long").alias("n"), F.col("nr").alias("pos"), F.col("root").alias("leaf")), height)
    last = top[-1].select("root").first()
    return Manifest(parts.join(roots.withColumnRenamed("root", "subroot"), "nr").select("part", "nr", "n", "subroot"), levels, top, last.root if last else None, height)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    def step(acc: Column, s: Column) -> Column:
        hash_ = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(hash_, acc)).otherwise(F.concat(acc, hash_)), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from below."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)


def verified(docs: DataFrame, changed: dict[str, Column], fields: Sequence[str] = FIELDS, order: str = "doc_id", part: str = "lang", height: int = HEIGHT) -> DataFrame:
    """Manifest of `docs`, and every row's proof held against its present fields (`changed` says which differ now).

    -> `order`, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    now = {f: changed.get(f, F.col(f)) for f in fields}
    rows = docs.select(F.col(order).alias("id"), F.col(part).alias("part"), digest(*map(F.col, fields)).alias("leaf"), digest(*now.values()).alias("present"))
    manifest = build(rows, "part", "id", "leaf", ["id", "present"], height)
    found = manifest.proofs().withColumn("folded_root", fold(F.col("present"), F.col("path")))
    root = F.lit(manifest.root).cast("string")
    return found.select(
        F.col("id").alias(order), "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
