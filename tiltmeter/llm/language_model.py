"""N-gram language model by deleted interpolation.

P(w | v) = l2[b] * c(v w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1), where b is the bucket of the context's
frequency c(v). Counts come from all training documents. The weights of each bucket are learned by expectation
maximisation: counts of the training documents outside the tuning part give the estimates, and the tuning part gives
the held-out events, gathered as a table of (bucket, ratio of the bigram and of the unigram estimate to the uniform
one, number of events). Ratios are kept in steps of 1/8 in log2, from 2**-40 to 2**40, so this table has a fixed largest size (`CELLS`)
whatever the corpus holds; it is the only thing that reaches the driver.

Counting is an exchange of pre-aggregated keys (see blocks.py): a chunk sends each distinct word and word pair once
with its counts, and gets back the totals. Keys are 64-bit hashes. Two workers share an executor with the JVM, so the
arrays of a chunk or bucket are narrow, freed as soon as they are used, and given back to the system.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; an end token follows the last word and counts as a token, so an
empty or null text has one token. The first word's context is a start mark, which is no token. One result per row,
also for repeated ids; a null id is a training document. With no training documents at all, every token has the
uniform probability 1 / (V + 1) = 1. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.llm.blocks import at_end, bucket_count, by_bucket, chunked, give_back, mix, pack, unpack, words_of
from tiltmeter.session import stage

START, END = np.uint64(0x5D1CE5B1A3F0C2E7), np.uint64(0x9A7E3C41D55B06F9)
BUCKETS = 32           # of context frequencies: 0, then by powers of two; the last holds all beyond 2**30
STEPS, REACH = 8, 640  # cells of a log2 ratio: steps per unit, steps from 2**-40 to 2**40
CELLS = BUCKETS * (REACH + 2) ** 2
SLICE = 1 << 16        # pairs hashed, or tokens scored, at once

_SPLIT = "chunk long, ids array<{id}>, parts binary, counts binary, places binary, words binary"
_SENT = "bucket int, chunk long, words binary, pairs binary, word_fit binary, word_tune binary, pair_fit binary, pair_tune binary"
_TOTALS = "chunk long, bucket int, word_fit binary, word_tune binary, pair_fit binary, pair_tune binary, known long, tokens long, known_fit long, tokens_fit long"


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in text.split(", "))])


def _split(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for chunk, rows in chunked(batches, "text"):
        yield _numbered(chunk, rows, id_type)


def _numbered(chunk: int, rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    """Numbers 0 and 1 are the start mark and the end token; `words` has the hash of every number."""
    number: dict[bytes, int] = {}
    places, counts = [], []
    for row in rows:
        words = words_of(row.pop("text"))
        for word in set(words).difference(number):
            number[word] = len(number) + 2
        own = np.ones(len(words) + 1, np.uint32)
        own[:-1] = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
        places.append(own)
        counts.append(len(own))
    hashes = np.empty(len(number) + 2, np.uint64)
    hashes[:2] = START, END
    hashes[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    return pa.record_batch({
        "chunk": pa.array([chunk], pa.int64()), "ids": pa.array([[r["id"] for r in rows]], pa.list_(id_type)),
        "parts": [pack(np.array([r["part"] for r in rows], np.uint8))], "counts": [pack(np.array(counts, np.uint32))],
        "places": [pack(np.concatenate(places))], "words": [hashes.tobytes()],
    })


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value starts."""
    return np.concatenate([np.zeros(min(1, len(ordered)), np.int64), np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, the number of each value among them), as `np.unique`, in half the memory."""
    order = np.argsort(values)
    ordered = values[order]
    starts = _starts(ordered)
    distinct = ordered[starts]
    del ordered
    inverse = np.empty(len(values), np.uint32)
    inverse[order] = np.repeat(np.arange(len(distinct), dtype=np.uint32), np.diff(starts, append=len(values)))
    return distinct, inverse


class _Chunk:
    """The tokens of a chunk with their contexts, and its distinct words; `codes` names the pairs."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.parts, self.counts = unpack(row["parts"], np.uint8), unpack(row["counts"], np.uint32).astype(np.int64)
        self.tokens = unpack(row["places"], np.uint32)
        self.first = np.cumsum(self.counts) - self.counts
        self.context = np.zeros(len(self.tokens), np.uint32)
        self.context[1:] = self.tokens[:-1]
        self.context[self.first] = 0

    def codes(self) -> np.ndarray:
        codes = self.context.astype(np.int64)
        codes *= len(self.words)
        codes += self.tokens
        return codes

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        keys = np.empty(len(codes), np.uint64)
        for at in range(0, len(codes), SLICE):
            a, b = np.divmod(codes[at : at + SLICE], len(self.words))
            with np.errstate(over="ignore"):
                keys[at : at + SLICE] = mix(self.words[a] * np.uint64(0x9E3779B97F4A7C15) ^ mix(self.words[b]))
        return keys

    def part_of_token(self) -> np.ndarray:
        return np.repeat(self.parts, self.counts)

    def pair_counts(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """(keys of the distinct pairs in the order of their codes, their counts in parts 0 and 1)."""
        codes = self.codes()
        codes *= 4
        codes += self.part_of_token()
        codes.sort()
        starts = _starts(codes)
        times, codes = np.diff(starts, append=len(codes)), codes[starts]
        part = (codes & 3).astype(np.uint8)
        codes >>= 2
        starts = _starts(codes)
        number = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(codes)))
        counts = {p: np.zeros(len(starts), np.uint32) for p in (0, 1)}
        for p, of in counts.items():
            of[number[part == p]] = times[part == p]
        return self.hashed(codes[starts]), counts


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _sent(row, buckets)


def _sent(row: dict, buckets: int) -> pa.RecordBatch:
    """Parts of documents: 0 gives estimates while tuning, 1 is the tuning part, 2 is outside the training."""
    chunk, out = _Chunk(row), {name: [] for name in _schema(_SENT).names}
    part = chunk.part_of_token()
    counted = {}
    for p, name in ((0, "fit"), (1, "tune")):
        words = np.bincount(chunk.tokens[part == p], minlength=len(chunk.words))
        words[0] = (chunk.parts == p).sum()
        counted[f"word_{name}"] = words.astype(np.uint32)
    pairs, counts = chunk.pair_counts()
    counted |= {"pair_fit": counts[0], "pair_tune": counts[1]}
    at_word, at_pair = dict(by_bucket(chunk.words, buckets)), dict(by_bucket(pairs, buckets))
    none = np.zeros(0, np.int64)
    for bucket in sorted({*at_word, *at_pair}):
        w, p = at_word.get(bucket, none), at_pair.get(bucket, none)
        out["bucket"].append(bucket)
        out["chunk"].append(row["chunk"])
        out["words"].append(chunk.words[w].tobytes())
        out["pairs"].append(pairs[p].tobytes())
        for name, values in counted.items():
            out[name].append(pack(values[w if name[0] == "w" else p]))
    return pa.RecordBatch.from_pydict(out, _schema(_SENT))


def _total(table: pa.Table) -> pa.Table:
    """Sum the counts of each key of a bucket over all chunks and answer every chunk."""
    rows, out = table.to_pylist(), {name: [] for name in _schema(_TOTALS).names}
    sums: dict[str, np.ndarray] = {}
    number: dict[str, np.ndarray] = {}
    ends: dict[str, np.ndarray] = {}
    stats = {}
    for kind in ("word", "pair"):
        keys = [np.frombuffer(row[f"{kind}s"], np.uint64) for row in rows]
        ends[kind] = np.cumsum([0, *map(len, keys)])
        distinct, number[kind] = _distinct(np.concatenate(keys))
        for name in ("fit", "tune"):
            total = sums[f"{kind}_{name}"] = np.zeros(len(distinct), np.uint64)
            for i, row in enumerate(rows):
                np.add.at(total, number[kind][ends[kind][i] : ends[kind][i + 1]].astype(np.intp), unpack(row[f"{kind}_{name}"], np.uint32).astype(np.uint64))
            if kind == "word":
                stats[name] = np.where(distinct == START, 0, total)
    for i, row in enumerate(rows):
        out["chunk"].append(row["chunk"])
        out["bucket"].append(row["bucket"])
        for name, values in sums.items():
            kind = name[:4]
            out[name].append(pack(values[number[kind][ends[kind][i] : ends[kind][i + 1]]]))
        both, once = stats["fit"] + stats["tune"], i == 0
        for name, value in (("known", (both > 0).sum()), ("tokens", both.sum()), ("known_fit", (stats["fit"] > 0).sum()), ("tokens_fit", stats["fit"].sum())):
            out[name].append(int(value) if once else 0)
    answered = pa.Table.from_pydict(out, _schema(_TOTALS))
    del rows, out, sums, number, keys, row, values
    give_back()
    return answered


def _answers(keys: np.ndarray, parts: pa.Table, buckets: int, names: tuple[str, ...]) -> np.ndarray:
    """Totals, summed over `names`, in the order of the keys."""
    by = {part["bucket"]: part for part in parts.select(["bucket", *names]).to_pylist()}
    out = np.zeros(len(keys), np.float64)
    for bucket, at in by_bucket(keys, buckets):
        for name in names:
            out[at] += unpack(by[bucket][name], np.uint64)
    return out


def _context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), BUCKETS - 1), 0).astype(np.int64)


def _cell(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + the step of log2(ratio); ratio 1 is in the middle."""
    return np.where(ratio > 0, 1 + np.clip(REACH // 2 + np.rint(STEPS * np.log2(np.maximum(ratio, 1e-300))), 0, REACH), 0).astype(np.int64)


def _events(chunks: pa.Table, parts: pa.Table, buckets: int, known: int, tokens: int) -> pa.Table:
    """Held-out events of a chunk, by cell."""
    chunk = _Chunk(chunks.to_pylist()[0])
    at = chunk.part_of_token() == 1
    pairs, pair = _distinct(chunk.codes())
    word = _answers(chunk.words, parts, buckets, ("word_fit",))
    count = _answers(chunk.hashed(pairs), parts, buckets, ("pair_fit",))
    context, uniform = word[chunk.context[at]], 1 / (known + 1)
    two = _cell(count[pair[at]] / np.maximum(context, 1) / uniform)
    one = _cell(word[chunk.tokens[at]] / max(tokens, 1) / uniform)
    cells, events = np.unique((_context_bucket(context) * (REACH + 2) + two) * (REACH + 2) + one, return_counts=True)
    del chunk, pairs, pair, count, context, two, one
    give_back()
    return pa.table({"cell": pa.array(cells, pa.int64()), "events": pa.array(events, pa.int64())})


def learn_weights(cells: np.ndarray, events: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket by expectation maximisation.

    A bucket without events keeps the starting weights; the uniform part never falls below 1e-6.
    """
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    rest, one = np.divmod(cells, REACH + 2)
    bucket, two = np.divmod(rest, REACH + 2)
    estimates = np.stack([np.where(c > 0, 2.0 ** ((c - 1 - REACH // 2) / STEPS), 0) for c in (two, one)] + [np.ones(len(cells))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * estimates
        share *= (events / share.sum(1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1)
        seen = sums.sum(1) > 0
        fresh = np.maximum(sums[seen] / sums[seen].sum(1, keepdims=True), [0, 0, 1e-6])
        weights[seen] = fresh / fresh.sum(1, keepdims=True)
    return weights


def _score(chunks: pa.Table, parts: pa.Table, buckets: int, known: int, tokens: int, weights: np.ndarray, schema: pa.Schema) -> pa.Table:
    row = chunks.to_pylist()[0]
    chunk = _Chunk(row)
    pairs, pair = _distinct(chunk.codes())
    words = _answers(chunk.words, parts, buckets, ("word_fit", "word_tune"))
    counts = _answers(chunk.hashed(pairs), parts, buckets, ("pair_fit", "pair_tune"))
    del pairs
    sums = [np.empty(len(chunk.counts), kind) for kind in (np.int64, np.float64, np.float64)]
    ends, doc = chunk.first + chunk.counts, 0
    while doc < len(ends):  # whole documents, about SLICE tokens at once
        start, after = chunk.first[doc], max(doc + 1, int(np.searchsorted(ends, chunk.first[doc] + SLICE, "right")))
        at = slice(start, ends[after - 1])
        context, count = words[chunk.context[at]], words[chunk.tokens[at]]
        mixed = weights[_context_bucket(context)]
        chance = mixed[:, 0] * counts[pair[at]] / np.maximum(context, 1) + mixed[:, 1] * count / max(tokens, 1) + mixed[:, 2] / (known + 1)
        if not tokens:
            chance = np.ones(len(chance))
        for out, x in zip(sums, ((count > 0).astype(np.int64), np.log10((count + 1) / (tokens + known + 1)), np.log10(chance)), strict=True):
            out[doc:after] = np.add.reduceat(x, chunk.first[doc:after] - start)
        doc = after
    scored = pa.Table.from_arrays([
        pa.array(row["ids"], schema.field("id").type), pa.array((chunk.parts == 2).tolist()), pa.array(chunk.counts), pa.array(sums[0]),
        pa.array([tokens] * len(chunk.counts), pa.int64()), pa.array(sums[1]), pa.array(sums[2]),
    ], schema=schema)
    del row, chunk, pair, counts, context, count, mixed, chance, x
    give_back()
    return scored


def score_texts(docs: DataFrame, part: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on parts 0 and 1 of `docs` (1 tunes the weights) and score every row.

    -> (`id_col`, held_out, n_tokens, n_known, train_tokens, base_score, score); base_score is the add-one unigram
    model, score the interpolated one, both log10.
    """
    spark, buckets = docs.sparkSession, bucket_count(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit(0)).cast("int").alias("part"), F.col(text_col).alias("text"))
    chunks = stage(source.mapInArrow(lambda b: at_end(_split(b, arrow_id)), _SPLIT.format(id=id_type.simpleString())), "tokens")
    sent = chunks.mapInArrow(lambda b: at_end(_send(b, buckets)), _SENT)
    totals = stage(sent.groupBy("bucket").applyInArrow(_total, _TOTALS), "totals")
    size = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "tokens", "known_fit", "tokens_fit"))).first()

    fit, whole = (size.known_fit, size.tokens_fit), (size.known, size.tokens)
    tuned = chunks.groupBy("chunk").cogroup(totals.select("chunk", "bucket", "word_fit", "pair_fit").groupBy("chunk")).applyInArrow(
        lambda left, right: _events(left, right, buckets, *fit), "cell long, events long"
    )
    table = tuned.groupBy("cell").agg(F.sum("events").alias("events")).toArrow()  # CELLS rows at most, 16 bytes each
    weights = learn_weights(table["cell"].to_numpy(), table["events"].to_numpy())

    result = T.StructType([
        T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    arrow = pa.schema([("id", arrow_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    scored = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        lambda left, right: _score(left, right, buckets, *whole, weights, arrow), result
    )
    return scored.withColumnRenamed("id", id_col)
