"""Quality classifier without labels: overlapping heuristic labellers teach a hashed linear scorer.

1. Every text is measured once; labellers vote good, bad or abstain on the measures.
2. Expectation maximisation over the counts of vote patterns (3 to the power of the labellers at most) estimates how
   often each labeller is right, and gives every pattern a posterior.
3. A logistic scorer on hashed features is trained on posterior labels of a sample: `SAMPLE` documents at most, those
   with the smallest hash of their id per class of posterior. This is the only step that does not read every document,
   and its bound does not grow with the input; it runs as one task.
4. Every document is scored whole by the scorer. It is kept if the score reaches `keep_at` (0 to 1).

Features: words and shapes of words, the measures in steps, all hashed into `WIDTH` weights; each document's vector
counts a feature's share of the text, so length does not matter by itself. Null and empty texts have the score 0 and are
not kept. Rows stay rows. Only the named columns and `keep` are read. An empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.llm.blocks import at_end
from tiltmeter.session import stage

WIDTH, SAMPLE = 1 << 16, 8000
LABELLERS = ("symbols", "repeats", "capitals", "tables", "run-ons", "variety", "lengths", "prose", "calm", "fresh")
_KINDS = np.zeros((0x800, 5), np.int64)  # by code point: capital, letter, symbol, end, bar; all beyond count as letters
for _code in range(len(_KINDS)):
    _c = chr(_code)
    _KINDS[_code] = (_c.isupper(), _c.isalpha(), _c in "#*$%&|<>{}\\^~=_", _c in ".!?", _c == "|")
_KINDS = np.vstack([_KINDS, [[0, 1, 0, 0, 0]]])


class _Words:
    """What a task knows of words, one row each: counts of capitals, letters, symbols, ends, bars, characters; two features."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1 << 16, 8), np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.number) > 300_000:
            self.number.clear()
        fresh = list(set(words).difference(self.number))
        if fresh:
            self._add(fresh)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _add(self, fresh: list[str]) -> None:
        first, last = len(self.number), len(self.number) + len(fresh)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        codes = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        new = self.table[first:last]
        new[:, :5] = np.add.reduceat(_KINDS[np.minimum(codes, len(_KINDS) - 1)], np.cumsum(sizes) - sizes)
        new[:, 5] = sizes
        new[:, 6] = np.fromiter((xxhash.xxh32_intdigest(word.lower()) for word in fresh), np.int64, len(fresh)) % WIDTH
        upper, letters, symbols, ends = new[:, :4].T
        others = sizes - letters - symbols - ends
        shape = np.minimum(upper, 3)
        for part, most in ((letters - upper, 3), (symbols, 4), (ends, 3), (others, 5), (sizes // 4, 6)):
            shape = shape * (most + 1) + np.minimum(part, most)
        new[:, 7] = (shape * 40503 + 17) % WIDTH
        self.number.update(zip(fresh, range(first, last), strict=True))


_WORDS = _Words()  # of the running task; emptied at its end, since workers live on


def measure(text: str) -> tuple[list[float], np.ndarray]:
    """Words, then shares per word (or per letter): symbols, repeated 5-word windows, capitals, bars, ends, distinct words,
    mean length; and the words' rows."""
    rows = _WORDS.rows(text.split())
    n = len(rows)
    if not n:
        return [0.0] * 8, rows
    repeated = 0.0
    if n > 4:
        with np.errstate(over="ignore"):
            grams = sum(rows[k : n - 4 + k] * np.int64(0x9E3779B97F4A7C1 + 2 * k * k) for k in range(5))
        grams.sort()
        same = grams[1:] == grams[:-1]
        repeated = float((np.append(same, False) | np.append(False, same)).mean())
    upper, letters, symbols, ends, bars, length = _WORDS.table[rows, :6].sum(0).tolist()
    return [float(n), symbols / n, repeated, upper / max(letters, 1), bars / n, ends / n, len(np.unique(rows)) / min(n, 2000), length / n], rows


def vote(m: list[float]) -> str:
    """One letter per labeller: g, b, or - to abstain. Labellers of one symptom never vote good; the last three look at several."""
    n, symbols, repeated, capitals, bars, ends, distinct, length = m
    looped, chopped = repeated > 0.45 and distinct < 0.5, ends > 0.6 and n >= 10
    one = (symbols > 0.2, looped, capitals > 0.5, bars > 0.2, chopped or (ends == 0 and n > 60), distinct < 0.12, length > 18)
    several = (
        (symbols > 0.2 or looped or chopped, 0.01 < ends < 0.4 and 2.5 < length < 10 and symbols < 0.05 and repeated < 0.1),
        (capitals > 0.5 or symbols > 0.2 or distinct < 0.12, capitals < 0.2 and symbols < 0.05 and 0 < ends < 0.4),
        (looped or symbols > 0.2 or capitals > 0.5, repeated < 0.05 and distinct > 0.2 and symbols < 0.05 and capitals < 0.2 and n >= 5),
    )
    return "".join(["b" if x else "-" for x in one] + ["b" if bad else "g" if good else "-" for bad, good in several])


def features(rows: np.ndarray, m: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their weights: words and word shapes by share, and steps of the measures."""
    hashed, words = np.unique(rows, return_counts=True)
    at, inverse = np.unique(_WORDS.table[hashed, 6:].T.ravel(), return_inverse=True)
    share = np.sqrt(np.bincount(inverse, np.tile(words, 2)) / max(1, len(rows)))
    steps = [f"{k} {min(20, int(x * 20)) if k not in (0, 7) else min(20, int(np.log2(1 + x) * 2))}" for k, x in enumerate(m)]
    return np.concatenate([at, [xxhash.xxh32_intdigest("step " + s) % WIDTH for s in steps]]), np.concatenate([share, np.ones(len(steps))])


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        measures = [measure(text or "")[0] for text in _texts(batch, "text")]
        yield pa.record_batch({"id": batch.column("id"), "mark": batch.column("mark"), "votes": pa.array([vote(m) if m[0] else "-" * len(LABELLERS) for m in measures], pa.string())})
    _WORDS.clear()


def posteriors(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of good per vote pattern: labellers that vote are right with an accuracy that expectation maximisation finds."""
    if not patterns:
        return {}
    sign = np.array([[{"g": 1, "b": -1, "-": 0}[v] for v in p] for p in patterns])
    weight = np.array(list(patterns.values()), float)
    right, prior = np.full(sign.shape[1], 0.85), 0.8
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sign @ np.log(right / (1 - right)))))
        prior = np.clip(weight @ good / weight.sum(), 0.5, 0.95)
        agreed = (weight * good) @ (sign > 0) + (weight * (1 - good)) @ (sign < 0)
        right = np.clip((agreed + 8.5) / (weight @ (sign != 0) + 10), 0.6, 0.99)  # ten votes of the starting accuracy
    return dict(zip(patterns, good.tolist(), strict=True))


def _train(table: pa.Table) -> pa.Table:
    """Logistic regression with soft labels by stochastic gradient steps in a fixed order."""
    rows = table.sort_by([("mark", "ascending"), ("text", "ascending")]).to_pylist()
    weights, squares = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-2)
    examples = []
    for row in rows:
        m, own = measure(row["text"])
        at, value = features(own, m)
        examples.append((np.append(at, WIDTH), np.append(value, 1.0), row["good"]))
    good = sum(e[2] for e in examples)
    balance = (len(examples) / (2 * max(good, 1.0)), len(examples) / (2 * max(len(examples) - good, 1.0)))
    order = np.random.default_rng(5)
    for _ in range(12):
        for i in order.permutation(len(examples)):
            at, value, label = examples[i]
            chance = 1 / (1 + np.exp(-np.clip(weights[at] @ value, -30, 30)))
            slope = (chance - label) * (label * balance[0] + (1 - label) * balance[1])
            gradient = slope * value + 1e-5 * weights[at]
            squares[at] += gradient**2
            weights[at] -= 0.2 * gradient / np.sqrt(squares[at])
    return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    return (text.as_py() for text in batch.column(name))


def _score_batches(batches: Iterator[pa.RecordBatch], text_col: str, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for text in _texts(batch, text_col):
            m, rows = measure(text or "")
            if not m[0]:
                scores.append(0.0)
                continue
            at, value = features(rows, m)
            scores.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ value + weights[WIDTH], -30, 30)))))
        yield batch.append_column("quality_score", pa.array(scores, pa.float64()))
    _WORDS.clear()


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), keep_at: float = 0.5) -> DataFrame:
    """-> `keep` columns, quality_score double, quality_kept boolean."""
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(5)).alias("mark"), F.col(text_col).alias("text"))
    voted = stage(source.mapInArrow(lambda batches: at_end(_vote_batches(batches)), "id string, mark long, votes string"), "votes")
    counts = {row.votes: row.n for row in voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()}  # bounded by the patterns
    counts.pop("-" * len(LABELLERS), None)
    table = posteriors(counts)
    if table:
        good = F.create_map(*(F.lit(x) for item in table.items() for x in item))[F.col("votes")]
        labelled = voted.withColumn("good", good).where("good is not null")
        sample = labelled.where("good >= 0.5").orderBy("mark", "id").limit(SAMPLE // 2).unionAll(labelled.where("good < 0.5").orderBy("mark", "id").limit(SAMPLE // 2))
        sample = stage(sample.dropDuplicates(["mark"]).select("mark", "good"), "sample")  # a mark names an id with its text
        texts = source.where(F.col("text").isNotNull()).join(F.broadcast(sample), "mark").dropDuplicates(["mark"])  # SAMPLE rows
        trained = texts.select(F.lit(0).alias("one"), "mark", "text", "good").groupBy("one").applyInArrow(_train, "weights binary").first()
        weights = np.frombuffer(trained.weights, np.float64)
    else:
        weights = np.zeros(WIDTH + 1)
    carried = docs.select(*dict.fromkeys([*keep, text_col]))
    schema = T.StructType([*carried.schema, T.StructField("quality_score", T.DoubleType())])
    scored = carried.mapInArrow(lambda batches: at_end(_score_batches(batches, text_col, weights)), schema)
    return scored.select(*keep, "quality_score", (F.col("quality_score") >= keep_at).alias("quality_kept"))
