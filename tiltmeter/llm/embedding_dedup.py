"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

1. Equal vectors of a label are one class row from here on, so any number of copies costs one row.
2. The class rows of a label (and dimension) are dealt to shards of about `SHARD` rows by a hash. One task per shard
   inserts its rows into a graph: levels by a keyed hash, links chosen among the nearest found by a beam search. Rows
   are inserted in batches, whose searches, choices and links back are array operations in single precision.
3. Every row queries every shard of its label. A task takes two shards, searches each one's graph for the other's rows,
   and joins what both directions found. In its own shard a row starts from itself; wide beams open more rows a step. The beam is widened as a whole until an audit of `AUDIT` queries against brute
   force finds `RECALL` of their `NEAREST` true neighbours, themselves left out, whether or not those are links; it is
   widened further for every query whose beam ends within the bound. A shard that fails the audit at `WIDEST`, and a query
   whose beam would outgrow it, are compared row by row, so no link is lost to the beam's width.
4. Found pairs are verified by their cosine in double precision. A task returns the number of links of each row and a
   spanning forest of the links; components of the forests' edges are the result. Pairs never leave a task.

Null, zero and empty vectors, vectors with null or non-finite components, and vectors without a label link with nothing;
vectors of different length are not compared. Rows stay rows, repeated ids too. Only the named columns are read. The
cost of step 3 is (rows of the label) x (shards of the label) searches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.blocks import mix, ranges
from tiltmeter.llm.components import components
from tiltmeter.session import stage

SHARD = 8192
LINKS, BUILD_BEAM, FIRST_BEAM, WIDEST = 12, 48, 48, 400
WAYS = 4  # rows of a beam that a step opens together, more in wide beams
AUDIT, NEAREST, RECALL, BATCH = 64, 10, 0.95, 256
COMPONENTS = 1 << 18  # of vectors that are multiplied at once
ROUNDING = 1e-4  # more than single precision takes from a cosine; found pairs are verified in double precision


def unit_rows(blob: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(blob, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, which: np.ndarray, b: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Products of the rows `which` of a with the rows `other` of b, a few of them at once."""
    out, step = np.empty(len(which), b.dtype), max(1, COMPONENTS // b.shape[1])
    for at in range(0, len(which), step):
        out[at : at + step] = np.einsum("ed,ed->e", a[which[at : at + step]], b[other[at : at + step]])
    return out


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for many queries at once -> (rows, similarities), best first, -1 and -9 where none."""
    q, n = len(queries), len(x)
    ids = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -9, x.dtype)
    ids[:, : entry.shape[1]] = entry[:, :width]
    sims[:, : entry.shape[1]] = np.where(ids[:, : entry.shape[1]] >= 0, np.einsum("qd,qed->qe", queries, x[ids[:, : entry.shape[1]]]), -9)
    first = np.arange(q) * (n + 1)
    ways, most = max(WAYS, width // 12), links.shape[1]
    seen = np.zeros(q * (n + 1), np.int16)  # not 0 once a query has met a row; row n, or -1, is none
    seen[(first[:, None] + ids).ravel()] = 1
    seen[first + n] = 1
    done = ids < 0
    rows = np.arange(q)
    while len(rows):
        undone = ~done[rows]
        live = undone.any(1)
        rows, undone = rows[live], undone[live]
        rank = np.cumsum(undone, 1, dtype=np.int16)
        which, at = np.nonzero(undone & (rank <= ways))  # beams are in order, nearest first
        opened = rows[which]
        done[opened, at] = True
        number = (rank[which, at, None] * most + np.arange(most)).astype(np.int16).ravel()  # differs among the links that a query opens
        near = (first[opened][:, None] + links[ids[opened, at]]).ravel()
        fresh = seen[near] == 0
        near, number = near[fresh], number[fresh]
        seen[near] = number
        near = near[seen[near] == number]  # a row that several links lead to is taken once
        who = near // (n + 1)
        near -= first[who]
        near_sims = cosines(queries, who, x, near)
        better = near_sims > sims[who, -1]  # others would leave the beam at once
        who, near, near_sims = who[better], near[better], near_sims[better]
        some, start, count = np.unique(who, return_index=True, return_counts=True)
        if not len(some):
            continue
        cell = np.repeat(np.arange(len(some)), count), np.arange(len(who)) - np.repeat(start, count)
        more_ids, more_sims = np.full((len(some), count.max()), -1, np.int64), np.full((len(some), count.max()), -9, x.dtype)
        more_ids[cell], more_sims[cell] = near, near_sims
        all_sims = np.concatenate([sims[some], more_sims], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        sims[some] = np.take_along_axis(all_sims, order, 1)
        ids[some] = np.take_along_axis(np.concatenate([ids[some], more_ids], 1), order, 1)
        done[some] = np.take_along_axis(np.concatenate([done[some], more_ids < 0], 1), order, 1)
    return ids, sims


class Graph:
    """Links of every level, -1 where none; row 0 of the order is the entry. Built and searched in single precision."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray], entry: int):
        self.x, self.levels, self.entry = x, levels, entry
        self.near_x = x.astype(np.float32)

    def search(self, queries: np.ndarray, width: int, down_to: int = 0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """With `own` the queries are these rows of the graph, and each starts from itself."""
        queries = queries.astype(np.float32)
        if own is not None:
            return beam_search(self.near_x, self.levels[down_to], queries, own[:, None], width)
        found = np.full((len(queries), 1), self.entry, np.int64)
        sims = np.full((len(queries), 1), -9, np.float32)
        for level in range(len(self.levels) - 1, down_to - 1, -1):
            found, sims = beam_search(self.near_x, self.levels[level], queries, found, width if level == down_to else 4)
        return found, sims

    @classmethod
    def build(cls, x: np.ndarray, keys: np.ndarray) -> Graph:
        """Insert rows in batches that grow with the graph; rows of a batch also see one another."""
        n = len(x)
        chance = (mix(keys.astype(np.uint64) ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum(8, np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(LINKS))).astype(np.int64)
        order = np.argsort(-level, kind="stable")  # upper levels first: the entry stays, every level grows on a finished one
        levels = [np.full((n + 1, 2 * LINKS if k == 0 else LINKS), -1, np.int64) for k in range(int(level.max()) + 1)]
        graph = cls(x, levels, int(order[0]))
        start = 0
        while start < n:
            batch = order[start : start + max(32, min(BATCH, start))]
            batch = batch[level[batch] == level[batch[0]]] if start else batch[level[batch] == level[order[0]]]
            among = graph.near_x[batch] @ graph.near_x[batch].T
            np.fill_diagonal(among, -9)
            for k in range(int(level[batch[0]]), -1, -1):
                if start:
                    ids, sims = graph.search(x[batch], BUILD_BEAM, k)
                    sims[np.isin(ids, batch)] = -9  # met on the level above; `among` has them
                else:
                    ids, sims = np.full((len(batch), 1), -1, np.int64), np.full((len(batch), 1), -9, np.float32)
                ids = np.concatenate([ids, np.broadcast_to(batch, (len(batch), len(batch)))], 1)
                graph._link(k, batch, ids, np.concatenate([sims, among], 1))
            start += len(batch)
        return graph

    def _link(self, k: int, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.levels[k]
        most = links.shape[1]
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        near = np.take_along_axis(sims, order, 1)
        chosen = self._choose(np.where(near > -5, np.take_along_axis(ids, order, 1), -1), near, LINKS)
        links[batch, : chosen.shape[1]] = chosen
        other, row = chosen[chosen >= 0], np.repeat(batch, (chosen >= 0).sum(1))  # and back
        new = (links[other] != row[:, None]).all(1)
        other, row = other[new], row[new]
        order = np.argsort(other, kind="stable")
        other, row = other[order], row[order]
        some, start, count = np.unique(other, return_index=True, return_counts=True)
        have = (links[some] >= 0).sum(1)
        place = np.arange(len(other)) - np.repeat(start - have, count)
        fits = np.repeat(have + count <= most, count)
        links[other[fits], place[fits]] = row[fits]
        full = np.flatnonzero(have + count > most)
        full = full[np.argsort(have[full] + count[full], kind="stable")]
        while len(full):  # rows with about as many candidates together
            sizes = have[full] + count[full]
            now = full[: max(1, int((np.arange(1, len(full) + 1) * sizes <= 16_384).sum()))]
            full = full[len(now) :]
            merged = np.full((len(now), sizes[len(now) - 1]), -1, np.int64)
            merged[:, : most] = links[some[now]]
            which = np.repeat(np.arange(len(now)), count[now])
            at = ranges(start[now], count[now])
            merged[which, place[at]] = row[at]
            near = np.where(merged >= 0, np.einsum("bcd,bd->bc", self.near_x[merged], self.near_x[some[now]]), -9)
            order = np.argsort(-near, axis=1, kind="stable")
            links[some[now]] = self._choose(np.take_along_axis(merged, order, 1), np.take_along_axis(near, order, 1), most)

    def _choose(self, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: one is left out if it is nearer to a chosen one than to the row; the nearest fill up.

        Candidates stand nearest first, with -1 after the last.
        """
        rows = self.near_x[own]
        inner = rows @ rows.transpose(0, 2, 1)
        free, chosen, count = own >= 0, np.zeros(own.shape, bool), np.zeros(len(own), np.int64)
        for i in range(own.shape[1]):
            chosen[:, i] = free[:, i] & (count < most)
            count += chosen[:, i]
            free &= ~chosen[:, i, None] | (inner[:, i] <= near)
        order = np.argsort(np.where(chosen, 0, np.where(own >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(own, order, 1)


def audited_beam(graph: Graph, queries: np.ndarray, own: bool) -> tuple[int, float]:
    """The first beam that finds `RECALL` of the true `NEAREST` neighbours of the audited queries, and its recall.

    With `own` the queries are the graph's rows, and a row is no neighbour of itself. The truth comes from all rows, so it
    is empty (recall 1) only where there is no other row. A recall below `RECALL` is that of `WIDEST`.
    """
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(np.int64))
    itself = audit[:, None] if own else np.full((len(audit), 1), -1)
    sims = queries[audit] @ graph.x.T
    if own:
        np.put_along_axis(sims, itself, -np.inf, 1)
    k = min(NEAREST, sims.shape[1] - own)
    if k < 1:
        return FIRST_BEAM, 1.0
    least = -np.partition(-sims, k - 1, 1)[:, k - 1 : k] - 1e-12  # of the true neighbours; ties are as good as they
    width = FIRST_BEAM
    while True:
        ids, _ = graph.search(queries[audit], width, own=audit if own else None)
        near = np.einsum("qd,qed->qe", queries[audit], graph.x[ids])
        hits = ((ids >= 0) & (ids != itself) & (near >= least)).sum(1)
        recall = float(np.minimum(hits, k).mean() / k)
        if recall >= RECALL or width >= WIDEST:
            return width, recall
        width = min(width * 2, WIDEST)


def found_links(graph: Graph, queries: np.ndarray, bound: float, own: bool = False) -> np.ndarray:
    """(queries x rows) which pairs reach the bound; where no beam passes the audit, by all products."""
    out = np.zeros((len(queries), len(graph.x)), bool)
    width, recall = audited_beam(graph, queries, own)
    if recall < RECALL:
        width = WIDEST + 1
    for start in range(0, len(queries), BATCH):
        rows, wide = np.arange(start, min(start + BATCH, len(queries))), width
        while len(rows) and wide <= WIDEST and wide < len(graph.x):
            ids, sims = graph.search(queries[rows], wide, own=rows if own else None)
            which, at = np.nonzero((ids >= 0) & (sims >= bound - ROUNDING))
            a, b = rows[which], ids[which, at]
            out[a, b] = cosines(queries, a, graph.x, b) >= bound
            rows, wide = rows[sims[:, -1] >= bound - ROUNDING], wide * 3  # the beam ends within the bound: there may be more
        if len(rows):
            out[rows] |= queries[rows] @ graph.x.T >= bound
    return out


def _forest(matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a bipartite link matrix, between ids."""
    edges, left, right = [], np.ones(len(a), bool), np.ones(len(b), bool)
    for start in range(len(a)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            row = queue.pop()
            for j in np.flatnonzero(matrix[row] & right).tolist():
                right[j] = False
                edges.append((int(a[row]), int(b[j])))
                for i in np.flatnonzero(matrix[:, j] & left).tolist():
                    left[i] = False
                    edges.append((int(a[i]), int(b[j])))
                    queue.append(i)
    return [(x, y) for x, y in edges if x != y]


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("rep")
    dim = table["dim"][0].as_py()
    vectors = np.asarray(table["vector"].combine_chunks().flatten(), np.float64)
    reps = np.asarray(table["rep"], np.int64)
    graph = Graph.build(unit_rows(vectors.tobytes(), dim), reps)
    return pa.table({
        "label": table["label"][:1].cast(pa.string()), "dim": table["dim"][:1], "shard": table["shard"][:1], "reps": pa.array([reps.tobytes()], pa.binary()),
        "copies": pa.array([np.asarray(table["copies"], np.int64).tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "levels": pa.array([[level.astype(np.int32).tobytes() for level in graph.levels]], pa.list_(pa.binary())), "entry": pa.array([graph.entry], pa.int64()),
    })


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, Graph]:
    reps, x = np.frombuffer(row["reps"], np.int64), unit_rows(row["vectors"], row["dim"])
    levels = [np.frombuffer(level, np.int32).reshape(len(x) + 1, -1).astype(np.int64) for level in row["levels"]]
    return reps, np.frombuffer(row["copies"], np.int64), Graph(x, levels, row["entry"])


def _compare(table: pa.Table, bound: float) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    a, copies_a, graph_a = _open(rows[0])
    if len(rows) == 1:
        matrix = found_links(graph_a, graph_a.x, bound, own=True)
        matrix |= matrix.T
        np.fill_diagonal(matrix, False)
        b, counts = a, [(a, matrix @ copies_a)]
    else:
        b, copies_b, graph_b = _open(rows[1])
        matrix = found_links(graph_b, graph_a.x, bound) | found_links(graph_a, graph_b.x, bound).T
        counts = [(a, matrix @ copies_b), (b, matrix.T @ copies_a)]
    edges = _forest(matrix, a, b)
    left, right, links = [x for x, _ in edges], [y for _, y in edges], [0] * len(edges)
    for reps, found in counts:
        some = np.flatnonzero(found)
        left += reps[some].tolist()
        right += [None] * len(some)
        links += found[some].tolist()
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "links": pa.array(links, pa.int64())})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bound: float = 0.93) -> DataFrame:
    """-> (`id_col` long, n_links long, component_id long, kept boolean), one per row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & F.expr(
        "coalesce(size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vector, x -> x <> 0), false)"
    )
    mark = (F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))
    good = rows.where(usable).select("id", "label", "vector", *mark)
    classes = good.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("dim", F.size("vector")), "classes")
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(SHARD)).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).withColumn("shard", F.expr("cast(pmod(xxhash64(rep), shards) as int)"))
    built = dealt.select("label", "dim", "shard", "rep", "copies", "vector").groupBy("label", "dim", "shard").applyInArrow(
        _build, "label string, dim int, shard int, reps binary, copies binary, vectors binary, levels array<binary>, entry long"
    )
    built = stage(built, "graphs")
    every = built.join(shards, ["label", "dim"])
    pairs = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    pairs = pairs.withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other")).drop("other", "shards")
    found = pairs.groupBy("label", "dim", "low", "high").applyInArrow(lambda table: _compare(table, bound), "a long, b long, links long")
    found = stage(found, "links")
    grouped = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.select("label", "h1", "h2", "rep", "copies").join(counts, "rep", "left").join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    keyed = rows.select("id", F.when(usable, F.col("label")).alias("label"), *mark)
    out = keyed.join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
