"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Units are the words of a text (and runs of single characters, joined: `i d i o t`). The kernel of two units sums over
all common subsequences of three characters, begin and end marks included, within `SPAN` places, weighted by
`DECAY` to the power of the places they cover, and is normalised; gaps and inserted characters lower it only a little.
The machine sees a unit as its kernel values with `LANDMARKS` units, in the coordinates that the landmarks' own kernel
matrix gives (Nystroem), and is linear there.

Labels are known for whole texts only. Training is multiple-instance: every sentence of a clean text is clean; of a
toxic text the units that look most toxic are positive, first by how much more often they occur in toxic texts, then by
the machine itself, fitted again. A logistic map from a text's largest unit values and its length to a probability is
fitted on the same texts. Training uses `SAMPLE` labelled texts of each class at most (those with the smallest hash of
their id), in one task: the bound does not grow with the input. Inputs of a score are the text alone.

All texts are scored, whole; null and empty ones have no units and get the score of a text without toxic units. Rows
stay rows. Only the named columns are read. Without labelled texts of both classes every score is 0.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.session import stage

SPAN, DECAY, LANDMARKS, SAMPLE = 8, 0.7, 512, 4000
LONGEST = 24   # longer units are read in overlapping pieces of this length
LETTERS = 64
TOP = 3
_SPACED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")
_VALUES: dict[str, float] = {}


def units_of(text: str) -> list[str]:
    low = text.lower()
    words = [w.strip(".,;:!?\"'()[]{}<>«»") for w in low.split()]
    words += ["".join(run.split()) for run in _SPACED.findall(low)]
    out = []
    for word in words:
        if len(word) <= LONGEST:
            if len(word) >= 3:
                out.append(word)
        else:
            out += [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]
    return out


@functools.lru_cache(maxsize=None)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three within the span, and their weights."""
    found = np.array([(i, j, k) for i, k in itertools.combinations(range(length), 2) if 2 <= k - i < SPAN for j in range(i + 1, k)], np.int64).reshape(-1, 3)
    return found, DECAY ** (found[:, 2] - found[:, 0] + 1.0)


def _letters(units: list[str]) -> np.ndarray:
    """Marked units of one length as letter numbers; letters beyond a-z share the other numbers by code point."""
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(units), -1)
    small = np.where((codes >= 97) & (codes <= 122), codes - 95, 28 + codes % 36)
    edge = np.ones((len(units), 1), np.int64)
    return np.hstack([0 * edge, small, edge])


def subsequences(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the units, features, weights) by length; the weights of a unit have norm 1 up to repeated features."""
    by_length: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        by_length.setdefault(len(unit), []).append(i)
    for members in by_length.values():
        for start in range(0, len(members), 5000):
            part = members[start : start + 5000]
            letters = _letters([units[i] for i in part])
            places, weights = _triples(letters.shape[1])
            a, b, c = (letters[:, places[:, k]] for k in range(3))
            yield np.array(part), (a * LETTERS + b) * LETTERS + c, weights


def _norms(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Norms of the units; a feature that occurs twice in a unit adds up."""
    order = np.argsort(features, axis=1)
    ordered, weight = np.take_along_axis(features, order, 1), weights[order]
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    starts = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(weight.ravel(), starts) ** 2
    return np.sqrt(np.bincount(starts // features.shape[1], sums, len(features)))


def values(units: list[str], direction: np.ndarray, bias: float) -> np.ndarray:
    """Decision values of units."""
    out = np.empty(len(units))
    for members, features, weights in subsequences(units):
        out[members] = direction[features] @ weights / _norms(features, weights) + bias
    return out


class _Kernel:
    """Normalised kernel values with a fixed set of landmarks."""

    def __init__(self, landmarks: list[str]):
        self.known = np.unique(np.concatenate([f.ravel() for _, f, _ in subsequences(landmarks)]))
        self.table = np.zeros((len(self.known) + 1, len(landmarks)), np.float32)
        for members, features, weights in subsequences(landmarks):
            scaled = weights[None, :] / _norms(features, weights)[:, None]
            np.add.at(self.table, (np.searchsorted(self.known, features), members[:, None]), scaled)

    def of(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.table.shape[1]), np.float32)
        for members, features, weights in subsequences(units):
            place = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
            place = np.where(self.known[place] == features, place, len(self.known))
            scale = _norms(features, weights)
            for start in range(0, len(members), 250):
                part = slice(start, start + 250)
                out[members[part]] = np.einsum("utl,t->ul", self.table[place[part]], weights.astype(np.float32)) / scale[part, None]
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 15) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        active = margin > 0
        xa, wa = x[active], weight[active]
        gradient = penalty * w - (xa * (wa * margin[active] * y[active])[:, None]).sum(0)
        hessian = penalty * np.eye(len(w)) + (xa * wa[:, None]).T @ xa
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _summary(found: np.ndarray) -> list[float]:
    """A text as the logistic map sees it: its largest unit values and its length."""
    top = np.sort(found)[::-1][:TOP]
    return [*np.pad(top, (0, TOP - len(top)), constant_values=-2.0), float(np.log1p(len(found))), 1.0]


def _train(table: pa.Table) -> pa.Table:
    rows = table.sort_by([("mark", "ascending"), ("text", "ascending")]).to_pylist()
    toxic = np.array([row["toxic"] for row in rows], bool)
    number: dict[str, int] = {}
    texts = []
    for row in rows:
        texts.append(np.array(sorted({number.setdefault(u, len(number)) for u in units_of(row["text"])}), np.int64))
    names = list(number)
    of = np.concatenate([texts[i] for i in np.flatnonzero(toxic)])
    bad = np.bincount(of, minlength=len(names)) / max(1, toxic.sum())
    good = np.bincount(np.concatenate([texts[i] for i in np.flatnonzero(~toxic)]), minlength=len(names)) / max(1, (~toxic).sum())
    half = 0.5 / len(rows)
    guess = np.log((bad + half) / (good + half)) * np.sqrt(bad)
    guess[bad * toxic.sum() < 2.5] = -9  # twice is chance
    common = np.argsort(-good, kind="stable")[: LANDMARKS // 2]
    landmarks = [names[i] for i in dict.fromkeys([*np.argsort(-guess, kind="stable")[: LANDMARKS - len(common)].tolist(), *common.tolist()])]
    kernel = _Kernel(landmarks)
    spectrum, vectors = np.linalg.eigh(kernel.of(landmarks).astype(np.float64))
    kept = spectrum > 1e-6 * spectrum.max()
    whiten = vectors[:, kept] / np.sqrt(spectrum[kept])

    clean = np.flatnonzero(good > 0)
    clean = clean[np.argsort(-good[clean], kind="stable")]
    clean = np.concatenate([clean[:10_000], clean[10_000 :: max(1, len(clean) // 10_000)]])
    current, direction, bias = guess, np.zeros(LETTERS**3), 0.0
    for turn in range(4):
        witness = {int(texts[i][np.argmax(current[texts[i]])]) for i in np.flatnonzero(toxic) if len(texts[i])}
        if not turn:
            witness = {u for u in witness if current[u] > 0} or witness
        else:
            witness = {u for u in witness if current[u] > -0.5} | set(np.flatnonzero(current > 0).tolist())
            hard = np.flatnonzero((good > 0) & (current > -0.7))  # clean units on the wrong side count in full from now on
            clean = np.unique(np.concatenate([clean, hard[np.argsort(-current[hard], kind="stable")][:5000]]))
        positive = np.array(sorted(u for u in witness if bad[u] > 4 * good[u]) or sorted(witness), np.int64)
        x = kernel.of([names[i] for i in [*positive, *clean]]) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(clean))])
        wrong = np.sqrt(good[clean]) * (1 if not turn else np.where(current[clean] > -0.7, 4, 1))
        weight = np.concatenate([np.sqrt(bad[positive]) / np.sqrt(bad[positive]).sum(), 2 * wrong / wrong.sum()])
        w = _svm(x, y, weight)
        direction = np.zeros(LETTERS**3)
        direction[kernel.known] = kernel.table[:-1].astype(np.float64) @ (whiten @ w[:-1])
        bias = float(w[-1])
        current = values(names, direction, bias)
    x, y = np.array([_summary(current[t]) for t in texts]), toxic.astype(float)
    map_weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ map_weights, -30, 30)))
        map_weights -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (p - y) + 0.05 * map_weights)
    model = np.concatenate([direction, [bias], map_weights])
    return pa.table({"model": pa.array([model.tobytes()], pa.binary())})


def _score(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    direction, bias, map_weights = model[: LETTERS**3], model[LETTERS**3], model[LETTERS**3 + 1 :]
    _VALUES.clear()
    for batch in batches:
        texts = [units_of(text or "") for text in batch.column("__text").to_pylist()]
        if len(_VALUES) > 600_000:
            _VALUES.clear()
        fresh = sorted({u for units in texts for u in units}.difference(_VALUES))
        _VALUES.update(zip(fresh, values(fresh, direction, bias).tolist(), strict=True))
        x = np.array([_summary(np.fromiter((_VALUES[u] for u in set(units)), np.float64)) for units in texts]).reshape(len(texts), -1)
        chance = 1 / (1 + np.exp(-np.clip(x @ map_weights, -30, 30))) if len(texts) else np.zeros(0)
        yield batch.drop_columns(["__text"]).append_column("toxicity", pa.array(chance, pa.float64()))
    _VALUES.clear()


def score_texts(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """-> `keep` columns, toxicity double. `labelled` has (`id_col`, toxic 0/1) of the texts to learn from."""
    wanted = labelled.where("toxic in (0, 1)").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col(id_col), F.lit(7)).alias("mark"))
    wanted = wanted.groupBy("id", "mark").agg(F.max("toxic").alias("toxic"))
    sample = stage(wanted.where("toxic = 1").orderBy("mark", "id").limit(SAMPLE).unionAll(wanted.where("toxic = 0").orderBy("mark", "id").limit(SAMPLE)), "sample")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # One text of every labelled id, the same in every run: 2 * SAMPLE rows, also where ids repeat.
    first = F.min(F.struct(F.xxhash64("text").alias("digest"), "text"))["text"]
    texts = stage(source.join(F.broadcast(sample), "id").groupBy("id", "mark", "toxic").agg(first.alias("text")), "labelled")
    carried = docs.select(*keep, F.col(text_col).alias("__text"))
    if texts.select("toxic").distinct().count() < 2:
        return carried.drop("__text").withColumn("toxicity", F.lit(0.0))
    trained = texts.select(F.lit(0).alias("one"), "mark", "text", "toxic").groupBy("one").applyInArrow(_train, "model binary").first()
    model = np.frombuffer(trained.model, np.float64).copy()
    schema = T.StructType([f for f in carried.schema if f.name != "__text"] + [T.StructField("toxicity", T.DoubleType())])
    return carried.mapInArrow(lambda batches: _score(batches, model), schema)
