"""Phrase collocations: frequent phrases of 2 to `max_words` words, counted in tiles of ranked ids, length by length.

A-Z is lowered; texts fall into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`. Everything is per language
(null: `und`). n counts word occurrences, f(phrase) all contiguous occurrences inside pieces. A phrase of at least `min_count`
occurrences is a candidate; all its parts are as frequent, so length k + 1 is looked for only where length k was found.

1. Chunks of a task's texts hold their word sequence and vocabulary. A chunk sends each of its distinct words once, packed
   by bucket of the word; the bucket sums them, and frequent words get dense ids by falling frequency. The bucket tells each
   chunk which of its words these are, and the ids go back to the chunks the same way; all other words become gaps.
2. A pair (id of the phrase of k words at a place, id of the word behind it) has an address in the plane of ids. The plane is
   cut into tiles of SIDE x SIDE ids. The DENSE x DENSE tiles of the most frequent ids are addressed directly and counted
   with `bincount`; all others are kept as sorted coordinates with counts and gathered in buckets by tile, whose number
   follows the data. A chunk sends one row per tile or bucket. A bucket's task has all rows of its tiles, so only frequent
   pairs leave it. Direct tiles, which every chunk has, are summed in two steps, by (tile, share of the chunks) and then by
   tile, so no task reads all chunks' rows of a hot tile.
3. Pairs of at least `min_count` are ranked by frequency and become the ids of the next round. The tiles answer each chunk
   with the ids of the pairs it sent, and the chunk keeps only places that can grow further.
4. Phrases are spelled out by joins; every cut of a phrase into two parts is scored floor(1000 a n / (l r)) in decimals of 38
   digits, the lowest score counts (ties: the shortest first part). A phrase whose words lie inside a longer candidate with
   the same count is dropped: some candidate one word longer then has that count too, so only those are looked at.

-> lang, rank (from 1), phrase, a, l, r, n, score: the first `top` of every language by score, then a, both descending, then
phrase. Null and empty texts have no words, an empty table no phrases. Rows are documents, repeated ones count again. Other
columns are not read. Texts are read whole and no phrase spans two documents. No table of words or phrases is collected or
broadcast by this module; ids of a round must stay below 2^31, beyond that it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.ordering import global_index
from tiltmeter.llm.blocks import at_end, bucket_count, by_bucket, give_back, mix, pack, runs, unpack
from tiltmeter.session import stage

CHUNK_CHARS = 24_000_000
SIDE = 1024
DENSE = 8
BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
_IDS = 1 << 31


def words_and_breaks(text: str | None) -> list[bytes]:
    """Words of a text in order, with BREAK between pieces and at the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(BREAK, b" " + BREAK + b" ").split() + [BREAK]


class _Buffer:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = {BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.chars = 0

    def add(self, text: str | None) -> None:
        tokens = words_and_breaks(text)
        for word in set(tokens).difference(self.number):
            self.number[word] = len(self.number)
        self.parts.append(np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens)))
        self.chars += len(text or "")


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 24
    open_: dict[str, _Buffer] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        for lang, buffer in open_.items():
            tokens = np.concatenate(buffer.parts)
            counts = np.bincount(tokens, minlength=len(buffer.number))[1:]
            yield pa.record_batch({
                "chunk": pa.array([chunk], pa.int64()), "lang": pa.array([lang], pa.string()), "n_words": pa.array([int(counts.sum())], pa.int64()),
                "sizes": pa.array([pack(np.fromiter(map(len, buffer.number), np.int32, len(buffer.number))[1:])], pa.binary()),
                "words": pa.array([pack(np.frombuffer(b"".join(buffer.number)[len(BREAK) :], np.uint8))], pa.binary()),
                "counts": pa.array([pack(counts.astype(np.int64))], pa.binary()), "tokens": pa.array([pack(tokens)], pa.binary()),
            })
            chunk += 1

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            buffer = open_.setdefault(lang, _Buffer())
            before = buffer.chars
            buffer.add(text.as_py())
            held += buffer.chars - before + 64
            if held >= limit:
                yield from rows()
                open_, held = {}, 0
    yield from rows()


_WORDS = pa.schema([
    ("bucket", pa.int64()), ("chunk", pa.int64()), ("lang", pa.string()), ("local", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()),
])
_WORDS_SQL = "bucket long, chunk long, lang string, local binary, sizes binary, words binary, counts binary"


def _split(sizes: bytes, words: bytes) -> list[bytes]:
    ends, raw = np.cumsum(unpack(sizes, np.int32), dtype=np.int64).tolist(), unpack(words, np.uint8).tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _send_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct words with their counts, by bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            words, counts = _split(row["sizes"], row["words"]), unpack(row["counts"], np.int64)
            of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.uint64, len(words))
            rows = []
            for bucket, at in by_bucket(of, buckets):
                own = [words[i] for i in at.tolist()]
                rows.append({
                    "bucket": bucket, "chunk": row["chunk"], "lang": row["lang"], "local": pack(np.diff(at, prepend=0).astype(np.int32)), "sizes": pack(np.fromiter(map(len, own), np.int32, len(own))),
                    "words": pack(np.frombuffer(b"".join(own), np.uint8)), "counts": pack(counts[at]),
                })
            yield pa.RecordBatch.from_pylist(rows, _WORDS)


_COUNTED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("place", pa.int64()), ("local", pa.binary()), ("places", pa.binary())])
_COUNTED_SQL = "bucket long, chunk long, lang string, word string, f long, place long, local binary, places binary"


def _count_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Frequent words of a bucket (rows without a chunk), and for every chunk its own among them (rows with one)."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    total: dict[tuple[str, bytes], int] = {}
    for row in rows:
        for word, n in zip(_split(row["sizes"], row["words"]), unpack(row["counts"], np.int64).tolist(), strict=True):
            total[row["lang"], word] = total.get((row["lang"], word), 0) + n
    found = {pair: place for place, pair in enumerate(pair for pair, n in total.items() if n >= least)}
    bucket = rows[0]["bucket"]
    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "lang": lang, "word": word.decode("utf-8", "surrogatepass"), "f": total[lang, word], "place": place} for (lang, word), place in found.items()], _COUNTED)
    for row in rows:
        places = np.fromiter((found.get((row["lang"], word), -1) for word in _split(row["sizes"], row["words"])), np.int64)
        hit = places >= 0
        if hit.any():
            local = np.cumsum(unpack(row["local"], np.int32), dtype=np.int64)[hit]
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "chunk": row["chunk"], "local": pack(local), "places": pack(places[hit])}], _COUNTED)


def _tell_words(told: pa.Table, words: pa.Table) -> pa.Table:
    """For every chunk the ids of its words of a bucket."""
    ids = np.zeros(words.num_rows, np.int64)
    ids[words.column("place").to_numpy()] = words.column("id").to_numpy()
    return pa.Table.from_pylist(
        [{"chunk": row["chunk"], "local": row["local"], "ids": pack(ids[unpack(row["places"], np.int64)])} for row in told.to_pylist()],
        pa.schema([("chunk", pa.int64()), ("local", pa.binary()), ("ids", pa.binary())]),
    )


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates, each once, with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(counts, starts)


def _tile(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the direct tile, or below zero the bucket of the tile."""
    row, column = a // SIDE, b // SIDE
    spread = mix((row << 32 | column).astype(np.uint64)) % np.uint64(buckets)
    return np.where((row < DENSE) & (column < DENSE), row * DENSE + column, -1 - spread.astype(np.int64))


def _cells(keys: np.ndarray) -> np.ndarray:
    """Address inside a direct tile."""
    return ((keys >> 32) % SIDE) * SIDE + (keys & 0xFFFFFFFF) % SIDE


def _keys_of_cells(tile: int, cells: np.ndarray) -> np.ndarray:
    a, b = (tile // DENSE) * SIDE + cells // SIDE, (tile % DENSE) * SIDE + cells % SIDE
    return a << 32 | b


def _pairs(words: np.ndarray, phrases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) where a phrase of k words is followed by a word, the last k of these k + 1 words being frequent too."""
    if len(words) <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, follower = phrases[: len(words) - k], words[k:]
    at = np.flatnonzero((first >= 0) & (follower >= 0) & (phrases[1 : len(words) - k + 1] >= 0))
    return at, first[at] << 32 | follower[at]


def _kept(words: np.ndarray, phrases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the places that a phrase of k + 1 words can cover; a gap stays where others were."""
    at, _ = _pairs(words, phrases, k)
    edges = np.zeros(len(words) + 2, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k + 1, -1)
    used = np.cumsum(edges)[: len(words)] > 0
    behind = np.concatenate([[False], used[:-1]]) & ~used if len(used) else used
    words, phrases = words.copy(), phrases.copy()
    words[behind] = phrases[behind] = -1
    return words[used | behind], phrases[used | behind]


def _state(chunk: int, words: np.ndarray, phrases: np.ndarray, k: int) -> dict:
    """Packed sequences; phrases of one word are the words."""
    words, phrases = _kept(words, phrases, k)
    return {"chunk": chunk, "words": pack(words + 1), "phrases": pack(phrases + 1) if k > 1 else None}


def _unstate(words: bytes, phrases: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    plain = unpack(words, np.int64) - 1
    return plain, plain if phrases is None else unpack(phrases, np.int64) - 1


_STATE = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("phrases", pa.binary())])
_STATE_SQL = "chunk long, words binary, phrases binary"


def _numbered(chunks: pa.Table, ids: pa.Table) -> pa.Table:
    """Word sequences of a chunk in ids; words without an id are gaps."""
    out = []
    for row in chunks.to_pylist():
        tokens = unpack(row["tokens"], np.int32)
        of = np.full(int(tokens.max(initial=0)) + 1, -1, np.int64)
        for part in ids.to_pylist():
            of[unpack(part["local"], np.int64) + 1] = unpack(part["ids"], np.int64)
        words = of[tokens]
        out.append(_state(row["chunk"], words, words, 1))
    give_back()
    return pa.Table.from_pylist(out, _STATE)


def _grown(states: pa.Table, answers: pa.Table, k: int) -> pa.Table:
    """Phrases of k words replaced by those of k + 1 words."""
    parts = answers.to_pylist()
    keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(p["steps"], np.int64)) for p in parts)])
    ids = np.concatenate([np.zeros(0, np.int64), *(unpack(p["ids"], np.int64) for p in parts)])
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    out = []
    for row in states.to_pylist():
        words, phrases = _unstate(row["words"], row["phrases"])
        at, wanted = _pairs(words, phrases, k)
        longer = np.full(len(words), -1, np.int64)
        if len(keys) and len(at):
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            longer[at] = np.where(keys[found] == wanted, ids[found], -1)
        out.append(_state(row["chunk"], words, longer, k + 1))
    give_back()
    return pa.Table.from_pylist(out, _STATE)


def _growing(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda states, answers: _grown(states, answers, k)


_SENT = pa.schema([("tile", pa.int64()), ("share", pa.int64()), ("chunk", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])
_SENT_SQL = "tile long, share long, chunk long, steps binary, counts binary"


def _send(batches: Iterator[pa.RecordBatch], k: int, buckets: int, shares: int, direct: bool) -> Iterator[pa.RecordBatch]:
    """A chunk's pair counts, of direct tiles or of buckets: bincount where a tile is well filled, else sorted coordinates."""
    for batch in batches:
        for chunk, words, phrases in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "phrases")), strict=True):
            _, keys = _pairs(*_unstate(words, phrases), k)
            tile = _tile(keys >> 32, keys & 0xFFFFFFFF, buckets)
            keys, tile = keys[(tile >= 0) == direct], tile[(tile >= 0) == direct]
            order = np.argsort(tile, kind="stable")
            keys, tile = keys[order], tile[order]
            rows: list[dict] = []
            for a, b in runs(tile):
                number, own = int(tile[a]), keys[a:b]
                if number >= 0 and b - a > SIDE * SIDE // 32:
                    filled = np.bincount(_cells(own), minlength=SIDE * SIDE)
                    cells = np.flatnonzero(filled)
                    own, counts = _keys_of_cells(number, cells), filled[cells]
                else:
                    own, counts = _summed(own, np.ones(len(own), np.int64))
                rows.append({"tile": number, "share": mix(np.array([chunk], np.uint64))[0] % np.uint64(shares) if number >= 0 else 0, "chunk": chunk,
                             "steps": pack(np.diff(own, prepend=np.int64(0))), "counts": pack(counts.astype(np.int64))})
            yield pa.RecordBatch.from_pylist(rows, _SENT)


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    """(tile, keys, counts) of all rows of a tile: a dense plane for well filled direct tiles, merged coordinates else."""
    tile, plane, waiting = 0, None, 0
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for batch in batches:
        for number, steps, own in zip(*(batch.column(c).to_pylist() for c in ("tile", "steps", "counts")), strict=True):
            tile = number
            at, n = np.cumsum(unpack(steps, np.int64)), unpack(own, np.int64)
            if plane is not None:
                plane[_cells(at)] += n
                continue
            keys.append(at)
            counts.append(n)
            waiting += len(at)
            if tile >= 0 and waiting > SIDE * SIDE // 4:
                plane = np.bincount(_cells(np.concatenate(keys)), np.concatenate(counts), SIDE * SIDE).astype(np.int64)
            elif waiting > 1 << 22:
                merged = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, waiting = [merged[0]], [merged[1]], 0
    if plane is not None:
        cells = np.flatnonzero(plane)
        return tile, _keys_of_cells(tile, cells), plane[cells]
    return (tile, *_summed(np.concatenate(keys), np.concatenate(counts)))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, keys, counts = _tile_sums(batches)
    yield pa.RecordBatch.from_pylist([{"tile": tile, "steps": pack(np.diff(keys, prepend=np.int64(0))), "counts": pack(counts)}], pa.schema([_SENT.field("tile"), _SENT.field("steps"), _SENT.field("counts")]))


_FOUND = pa.schema([("tile", pa.int64()), ("chunk", pa.int64()), ("first", pa.int64()), ("follower", pa.int64()), ("f", pa.int64()), ("steps", pa.binary())])
_FOUND_SQL = "tile long, chunk long, first long, follower long, f long, steps binary"


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Frequent pairs of a tile (rows without a chunk), and for a bucket every chunk's own among them (rows with one)."""
    held = list(batches)  # packed
    tile, keys, counts = _tile_sums(iter(held))
    keys, counts = keys[counts >= least], counts[counts >= least]
    nothing = pa.nulls(len(keys), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), tile)), nothing, pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts), pa.nulls(len(keys), pa.binary())], schema=_FOUND)
    if tile < 0 and len(keys):
        for batch in held:
            for chunk, steps in zip(batch.column("chunk").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                own = np.cumsum(unpack(steps, np.int64))
                own = own[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own]
                if len(own):
                    yield pa.RecordBatch.from_pylist([{"tile": tile, "chunk": chunk, "steps": pack(np.diff(own, prepend=np.int64(0)))}], _FOUND)


def _answer(sent: pa.Table, found: pa.Table) -> pa.Table:
    """For every chunk the frequent pairs among those that it sent, with their ids."""
    keys, ids = found.column("first").to_numpy() << 32 | found.column("follower").to_numpy(), found.column("id").to_numpy()
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    out = []
    for at in range(sent.num_rows):
        own = np.cumsum(unpack(sent.column("steps")[at].as_py(), np.int64))
        if len(keys):
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[place] == own
            if hit.any():
                out.append({"chunk": sent.column("chunk")[at].as_py(), "steps": pack(np.diff(own[hit], prepend=np.int64(0))), "ids": pack(ids[place[hit]])})
    return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("steps", pa.binary()), ("ids", pa.binary())]))


def _ranked(found: DataFrame, order: list, name: str) -> DataFrame:
    """Dense ids by falling frequency."""
    ranked = global_index(found, [F.col("f").desc(), *order], "id")
    return stage(ranked.withColumn("id", F.when(F.col("id") < _IDS, F.col("id")).otherwise(F.raise_error(F.lit("too many frequent phrases"))).cast("long")), name)


def frequent_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, phrase, words, f for 1 to `max_words` words of at least `min_count` occurrences; totals: lang, n)."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    limit = CHUNK_CHARS
    chunks = stage(source.mapInArrow(lambda batches: at_end(_chunks(batches, limit)), "chunk long, lang string, n_words long, sizes binary, words binary, counts binary, tokens binary"), "word-chunks")
    totals = stage(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-size[0] >> 23), min(bucket_count(spark), size[0] >> 16))
    shares = max(1, int(np.ceil(np.sqrt(size[1]))))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_words(batches, min_count)

    sent = chunks.select("chunk", "lang", "sizes", "words", "counts").mapInArrow(lambda batches: at_end(_send_words(batches, buckets)), _WORDS_SQL)
    counted = stage(sent.groupBy("bucket").applyInArrow(count_words, _COUNTED_SQL), "counted")
    words = _ranked(counted.where("chunk IS NULL").select("bucket", "place", "lang", "word", "f"), ["lang", "word"], "words")
    told = counted.where("chunk IS NOT NULL").select("bucket", "chunk", "local", "places")
    back = told.groupBy("bucket").cogroup(words.select("bucket", "place", "id").groupBy("bucket")).applyInArrow(_tell_words, "chunk long, local binary, ids binary")
    states = stage(chunks.select("chunk", "tokens").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_numbered, _STATE_SQL), "sequences")

    spelled = words.select("id", "lang", F.col("word").alias("phrase"), F.array("word").alias("words"), "f")
    lengths, last = [spelled], spelled
    for k in range(1, max_words):
        hot = stage(states.mapInArrow(lambda batches, k=k: at_end(_send(batches, k, buckets, shares, True)), _SENT_SQL), "pairs")
        rare = states.mapInArrow(lambda batches, k=k: at_end(_send(batches, k, buckets, shares, False)), _SENT_SQL)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _partial(batches)

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _frequent(batches, min_count)

        summed = hot.drop("chunk").groupBy("tile", "share").applyInArrow(partial, "tile long, steps binary, counts binary")
        hot_found = summed.groupBy("tile").applyInArrow(frequent, _FOUND_SQL)
        rare_found = stage(rare.drop("share").groupBy("tile").applyInArrow(frequent, _FOUND_SQL), "rare")
        pairs = hot_found.unionByName(rare_found.where("chunk IS NULL")).select("tile", "first", "follower", "f")
        found = _ranked(pairs, ["first", "follower"], "phrases")
        if found.isEmpty():
            break
        longer = (
            found.join(last.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), F.col("words").alias("heads")), "first")
            .join(words.select(F.col("id").alias("follower"), "word"), "follower")
            .select("id", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), F.concat("heads", F.array("word")).alias("words"), "f")
        )
        last = stage(longer, "spelled")
        lengths.append(last)
        if k + 1 < max_words:
            # A direct tile's ids go to every share of the chunks.
            share = F.when(F.col("tile") >= 0, F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
            ids = found.select("tile", "first", "follower", "id", F.explode(share).alias("share"))
            asked = hot.select("tile", "share", "chunk", "steps").unionByName(rare_found.where("chunk IS NOT NULL").select("tile", F.lit(0).cast("long").alias("share"), "chunk", "steps"))
            answers = asked.groupBy("tile", "share").cogroup(ids.groupBy("tile", "share")).applyInArrow(_answer, "chunk long, steps binary, ids binary")
            states = stage(states.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_growing(k), _STATE_SQL), "sequences")
    phrases = lengths[0].drop("id")
    for table in lengths[1:]:
        phrases = phrases.unionByName(table.drop("id"))
    return phrases, totals


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best scored phrases of every language -> lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, min_count, max_words, text_col, lang_col)
    candidates = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    counts = phrases.select("lang", "phrase", "f")

    def part(begin: str, length: str) -> F.Column:
        return F.expr(f"array_join(slice(words, {begin}, {length}), ' ')")

    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)"))).select(
        "lang", "phrase", "a", "k", part("1", "k").alias("head"), part("k + 1", "size(words) - k").alias("tail"),
    )
    known = (
        cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    )
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    known = known.withColumns({"over": wide["a"] * 1000 * wide["n"], "under": wide["l"] * wide["r"]}).withColumn("score", F.expr("over div under"))
    lowest = known.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))

    inside = candidates.where(F.size("words") > 2).select(
        "lang", F.explode(F.array(part("1", "size(words) - 1"), part("2", "size(words) - 1"))).alias("phrase"), F.col("a").alias("longer"),
    ).distinct()
    scored = lowest.select("lang", "phrase", F.col("cut.a").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.n").alias("n"), F.col("cut.score").alias("score"))
    alone = scored.join(inside, (scored["lang"] == inside["lang"]) & (scored["phrase"] == inside["phrase"]) & (scored["a"] == inside["longer"]), "left_anti")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return alone.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
