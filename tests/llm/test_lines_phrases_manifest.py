"""Line deduplication, collocations and the Merkle manifest against brute force, on odd rows too."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.llm import collocations, line_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk string, path string, tile long"
LINES = ["Shared Line", "  shared line\t", "other", "", " ", "é Ü", "é ü", "a, b c. a b", "a b c d e f g; a b c d e f g", "Z\r", "one two three four five six"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        text = "\n".join(LINES[k] for k in rng.integers(0, len(LINES), rng.integers(1, 9)))
        rows.append((int(rng.integers(0, 60)), text, ["en", "de", None, "und"][i % 4], None if i % 9 == 0 else "s", None if i % 7 == 0 else i))
    rows += [(1, None, "en", None, None), (None, "", None, None, None), (None, "other\nother", "en", "s", 3), (None, "other\nother", "en", "s", 3)]
    rows += [(2, "x y " * 4000, "en", "s", 5), rows[0], rows[0]]
    return [(*r, "a", "b", "c", 1) for r in rows]  # extra columns clash with the operators' own names


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_docs, min_chars=1):
    """All lines of repeated keys dropped."""
    held = Counter()
    for _, text in rows:
        held.update({key(line) for line in (text or "").split("\n")})
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(key(line)) < min_chars or held[key(line)] < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("min_docs", "min_chars", "limit"), [(10, 1, 24_000_000), (2, 1, 300), (3, 4, 40)])
def test_lines_of_repeated_keys_go(docs, monkeypatch, min_docs, min_chars, limit):
    monkeypatch.setattr(line_dedup, "CHUNK_CHARS", limit)  # many small chunks
    found = line_dedup.dedup_lines(docs, min_docs, min_chars, "none", keep_columns=["path"]).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found), key=str) == sorted(brute_lines([r[:2] for r in _rows()], min_docs, min_chars), key=str)
    assert {r.path for r in found} == {"c"}


def test_first_occurrence_stays(spark, empty):
    rows = [(4, "k\nx\nK "), (3, "y\n k"), (None, "k"), (9, "z"), (9, "x")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.kept_text, r.n_dropped) for r in found} == {(4, "x", 2), (3, "y\n k", 0), (None, "", 1), (9, "z", 0), (9, "", 1)}
    assert line_dedup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(empty, min_docs=1)


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << 32, 4000, dtype=np.uint64)).astype(np.uint32) for _ in range(6)]
    parts[4] = np.union1d(parts[4], parts[0][:700]).astype(np.uint32)
    pair = line_dedup.FilterPair(sum(map(len, parts)))
    for part in parts:
        pair.add(part, np.zeros(len(part), bool))
    assert pair.suspected(parts[0][:700]).all()
    assert pair.suspected(parts[2]).mean() < 0.03  # single values that are suspected all the same


def brute_phrases(rows, least, most, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= own[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "top", "limit"), [(4, 5, 2000, 24_000_000), (2, 3, 5, 200), (1, 4, 50, 1000)])
def test_collocations(docs, monkeypatch, least, most, top, limit):
    monkeypatch.setattr(collocations, "CHUNK_CHARS", limit)
    found = sorted(map(tuple, collocations.collocations(docs, least, most, top).collect()))
    assert found == brute_phrases([r[1:3] for r in _rows()], least, most, top) and found


def test_no_phrases(empty, spark):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")).count() == 0


def test_tiles_hold_every_pair():
    """Direct and bucketed tiles, dense and sparse counting: the same sums as a plain count."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    a, b = (np.minimum(rng.zipf(1.2, 200_000), 40_000) - 1 for _ in range(2))
    keys = a.astype(np.int64) << 32 | b
    tile = collocations._tile(a.astype(np.int64), b.astype(np.int64), 5)
    assert set(tile[(a < 8 * 1024) & (b < 8 * 1024)].tolist()) <= set(range(64)) and set(tile[a >= 8 * 1024].tolist()) <= set(range(-5, 0))
    summed = Counter()
    for number in np.unique(tile).tolist():
        parts = np.array_split(keys[tile == number], 3)
        rows = [collocations._summed(p, np.ones(len(p), np.int64)) for p in parts]
        batches = (pa.record_batch({"tile": [number], "steps": [collocations.pack(np.diff(k, prepend=0))], "counts": [collocations.pack(n)]}) for k, n in rows if len(k))
        got, found, counts = collocations._tile_sums(batches)
        assert got == number
        summed.update(dict(zip(found.tolist(), counts.tolist(), strict=True)))
    assert summed == Counter(keys.tolist())


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(hashes):
    paths, index = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, path in enumerate(paths):
            other = index[i] ^ 1
            path.append(None if other >= len(hashes) else (other > index[i], hashes[other]))
            index[i] //= 2
        hashes = [H(*hashes[k : k + 2]) for k in range(0, len(hashes), 2)]
    return hashes[0], paths


def brute_manifest(rows):
    parts = {}
    for doc, text, lang, source, n_chars in rows:
        tampered = n_chars if n_chars is None or doc is None or zlib.crc32(str(doc).encode()) % 7 else n_chars + 1
        parts.setdefault(lang, []).append((doc is not None, doc or 0, leaf_of((doc, source, lang, n_chars, text)), leaf_of((doc, source, lang, tampered, text)), doc))
    order = sorted(parts, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: brute_tree([r[2] for r in sorted(parts[lang])]) for lang in order}
    root, above = brute_tree([trees[lang][0] for lang in order])
    out = []
    for number, lang in enumerate(order):
        for row, path in zip(sorted(parts[lang], key=lambda r: r[:4]), trees[lang][1], strict=True):
            path, folded = path + above[number], row[3]
            for step in path:
                folded = H(folded) if step is None else H(folded, step[1]) if step[0] else H(step[1], folded)
            out.append((row[4], row[2], trees[lang][0], root, H(*(s[1] for s in path if s)), folded, folded == root))
    return sorted(out, key=str)


def tampered(docs, height):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return merkle.verified(docs, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, height=height)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest(docs, height):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in _rows()]
    found = sorted(map(tuple, tampered(docs, height).collect()), key=str)
    assert found == brute_manifest([(d, t, lang, s, n) for d, t, lang, s, n in rows])
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_manifest_of_one_and_none(spark, empty):
    one = spark.createDataFrame([(7, "t", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    row = tampered(one, 10).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf_of((7, None, None, None, "t")) and row.proof_sha256 == H() and row.verified
    assert tampered(empty, 10).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 6, 11])
def test_van_emde_boas_addresses(levels):
    """Every node has an address of its own, and every subtree of the lower half lies together."""
    at = {(d, i): int(a) for d in range(levels) for i, a in enumerate(merkle.addresses(levels, d, np.arange(1 << d)))}
    assert sorted(at.values()) == list(range((1 << levels) - 1)) and at[0, 0] == 0
    top = levels // 2
    for root in range(1 << top) if top else ():
        own = sorted(at[d, i] for d in range(top, levels) for i in range(root << (d - top), (root + 1) << (d - top)))
        assert own == list(range(own[0], own[0] + len(own)))
