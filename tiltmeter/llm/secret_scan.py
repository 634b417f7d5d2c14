"""Secrets in texts: known forms, and unnamed random strings found by a battery of randomness tests.

Known forms (`assign`, `access`, `hex`) are leftmost non-overlapping matches of their pattern. Any other run of 20
characters or more of a code alphabet is a candidate, and so is any run as long inside it without `/` and `+`, without
`_` and `-`, or without all four: a secret in a path stands between these. From its characters its encoding is inferred
(the smallest alphabet that holds them all; `/` or `+` with `_` or `-` has none); a run of letters of one case has none,
since words look alike. Four tests ask whether the string could be drawn at random from that alphabet: chi-squared of the
character counts, chi-squared of the counts of its classes (capitals, small letters, others; single characters are too
rare in short strings to tell words in camel case), Wald-Wolfowitz runs above and below the middle of the alphabet, and
lag-1 serial correlation. `p` is the chance that the smallest of four such p-values is as small as theirs; below `FLOOR`
the string is not random.

What passes the battery may still be words that are too short to tell. The null hypothesis to be rejected is therefore
that the string is word-like: drawn from a fixed chain of classes and letter pairs (`SHIFTS`, `PAIRS`). Its chance under
that chain, divided by its chance under random draws, bounds the p-value of this null; `bits` is its negative log2. It
depends on the string alone, so a lone secret of a rare length has the same p-value as one among many. A string is a
secret if its bits reach the threshold that holds the false-discovery rate of all candidates at `fdr` (Benjamini and
Hochberg): the table behind this has CELLS rows at most and covers all candidates of the input. Of accepted strings
inside each other the longest is listed.

Everything is SQL functions. A null text counts as empty. Rows stay rows, also repeated ones; positions are code points,
ends exclusive. Long texts are scanned whole. Columns named by `keep` are carried along; columns of any other name are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.session import stage

# The patterns of the known forms, in their order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PIECES = (r"[A-Za-z0-9_-]{20,}={0,2}", r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9]{20,}={0,2}")
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (pattern of the whole string, alphabet in order), from small to large.
ENCODINGS = (
    ("[0-9a-f]+", DIGIT + LOWER[:6]), ("[0-9A-F]+", DIGIT + UPPER[:6]), ("[A-Z2-7]+", UPPER + DIGIT[2:8]), ("[a-z0-9]+", LOWER + DIGIT), ("[A-Z0-9]+", UPPER + DIGIT),
    ("[A-Za-z0-9]+", UPPER + LOWER + DIGIT), ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGIT + "+/"), ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGIT + "-_"),
)
CELLS, FLOOR = 256, 0.01
#: Words: bits of the step from one class to the next (small letter, capital, digit, other), in rows; bits of a first or
#: lone letter, a digit, another character; bits less 1 of a small letter after a letter, 26 x 26 (words of program texts).
SHIFTS = (0.2, 4.0, 4.5, 3.5, 1.1, 1.1, 5.0, 5.0, 4.0, 4.0, 0.4, 3.0, 1.0, 2.5, 2.0, 4.0)
LETTER, NUMERAL, OTHER = 4.7, 3.4, 2.0
PAIRS = (
    "94339659395232949232557659264629983491683693362999482957289239336818946249997937740779189486389536378959"
    "37324458698442746223856369296722791993872893543999493878185329936346933536898819981899299767199463599969"
    "44344449897331259432949695396709985948881697571989794965066829938366852659397927741689298287269734477939"
    "14861999398647229846499979383225284955853698225599696543656959643143924334489829762896398288238253498949"
    "88868898889687997478099999275416492966443694334769494947177429656633872139695929561792199578369234486949"
    "44453559499232639222999899189908792999774898999989991875289219959329924899579936162586299659629751888458"
    "5556367829944332942286496638680888299557379667899967"
)


def _lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 1) -> str:
    """SQL: array of (start, kind, stop, string) of the matches whose group has `least` characters. Texts without a match cost one search."""
    p = _lit(pattern)
    step = (
        f"named_struct('at', acc.at + length(pieces[i]) + length(hits[i]), 'out', if(length(held[i]) >= {least}, "
        f"array_append(acc.out, named_struct('start', acc.at + length(pieces[i]), 'kind', {kind}, 'stop', acc.at + length(pieces[i]) + length(hits[i]), 'string', hits[i])), acc.out))"
    )
    none = "cast(array() as array<struct<start:int,kind:int,stop:int,string:string>>)"
    found = (
        f"transform(array(named_struct('hits', regexp_extract_all({text}, {p}, 0), 'held', regexp_extract_all({text}, {p}, {group}), 'pieces', split({text}, {p}, -1))), "
        f"m -> aggregate(sequence(0, size(m.hits) - 1), named_struct('at', 0, 'out', {none}), (acc, i) -> {step}).out)[0]"
    )
    for name in ("hits", "held", "pieces"):
        found = found.replace(f"({name}[i]", f"(m.{name}[i]").replace(f", {name}[i])", f", m.{name}[i])")
    return f"if(rlike({text}, {p}), {found}, {none})"


def _normal(z: str) -> str:
    """SQL: upper tail of the normal distribution (logistic form, error below 0.0002)."""
    return f"(1 / (1 + exp(least(700D, 1.5976 * ({z}) + 0.07056 * pow({z}, 3)))))"


def _battery() -> list[tuple[str, str]]:
    """Steps that turn `c` (start, stop, string) into test results; each is (field, SQL over the struct so far)."""
    whole = "regexp_replace(c.string, '=+$', '')"
    mixed = "(rlike(c.body, '[0-9]') and rlike(c.body, '[A-Za-z]') or rlike(c.body, '[a-z]') and rlike(c.body, '[A-Z]'))"
    alphabet = "case when not " + mixed + " then null " + " ".join(f"when rlike(c.body, {_lit('^' + p + '$')}) then {_lit(a)}" for p, a in ENCODINGS) + " end"
    of_class = "length(regexp_replace({}, '[^{}]', ''))"
    classes = ", ".join(f"named_struct('seen', {of_class.format('c.body', k)}, 'among', {of_class.format('c.alphabet', k)})" for k in ("A-Z", "a-z", "0-9+/_-"))
    kind_of = "locate(substring(c.shape, {}, 1), 'luds')"
    nth = "ascii(substring(c.small, {}, 1)) - 97"
    letter = f"1D + cast(substring({_lit(PAIRS)}, 26 * ({nth.format('i - 1')}) + {nth.format('i')} + 1, 1) as int)"
    lone = f"case substring(c.shape, {{}}, 1) when 'd' then {NUMERAL}D when 's' then {OTHER}D else {LETTER}D end"
    shift = f"array({', '.join(f'{x}D' for x in SHIFTS)})[4 * {kind_of.format('i - 1')} + {kind_of.format('i')} - 5]"
    step = f"{shift} + if(substring(c.shape, i - 1, 2) in ('ll', 'ul', 'uu'), {letter}, {lone.format('i')})"
    pairs = "zip_with(slice(c.codes, 1, c.n - 1), slice(c.codes, 2, c.n - 1), (x, y) -> {})"
    return [
        ("body", whole),
        ("alphabet", alphabet),
        ("n", "length(c.body)"),
        ("a", "length(c.alphabet)"),
        ("codes", "transform(sequence(1, c.n), i -> cast(instr(c.alphabet, substring(c.body, i, 1)) as double))"),
        ("squares", "aggregate(array_distinct(c.codes), 0D, (s, x) -> s + pow(size(filter(c.codes, y -> y = x)), 2))"),
        ("high", "cast(size(filter(c.codes, x -> x * 2 > c.a)) as double)"),
        ("runs", f"1D + size(filter({pairs.format('(x * 2 > c.a) <> (y * 2 > c.a)')}, d -> d))"),
        ("mean", "aggregate(c.codes, 0D, (s, x) -> s + x) / c.n"),
        ("spread", "aggregate(c.codes, 0D, (s, x) -> s + pow(x - c.mean, 2))"),
        ("lagged", f"aggregate({pairs.format('(x - c.mean) * (y - c.mean)')}, 0D, (s, x) -> s + x)"),
        ("expected", "2 * c.high * (c.n - c.high) / c.n"),
        ("z_chi", "(pow((c.a * c.squares / c.n - c.n) / (c.a - 1), 1 / 3D) - (1 - 2 / (9D * (c.a - 1)))) / sqrt(2 / (9D * (c.a - 1)))"),
        ("z_runs", "if(c.expected <= 1, 9D, abs(c.runs - 1 - c.expected) / sqrt(c.expected * (c.expected - 1) / (c.n - 1)))"),
        ("z_serial", "if(c.spread = 0, 9D, abs(c.lagged / c.spread + 1D / c.n) * sqrt(c.n))"),
        ("classes", f"filter(array({classes}), k -> k.among > 0)"),
        ("chi_classes", "aggregate(c.classes, 0D, (s, k) -> s + pow(k.seen - c.n * k.among / c.a, 2) / (c.n * k.among / c.a))"),
        ("p_classes", f"if(size(c.classes) = 3, exp(-c.chi_classes / 2), 2 * {_normal('sqrt(c.chi_classes)')})"),
        ("p", f"1 - pow(1 - least(1D, {_normal('c.z_chi')}, c.p_classes, 2 * {_normal('c.z_runs')}, 2 * {_normal('c.z_serial')}), 4)"),
        ("shape", f"translate(c.body, {_lit(LOWER + UPPER + DIGIT + '+/_-')}, {_lit('l' * 26 + 'u' * 26 + 'd' * 10 + 's' * 4)})"),
        ("small", "lower(c.body)"),
        ("bits", f"aggregate(sequence(2, c.n), 2D + {lone.format(1)}, (s, i) -> s + {step}) - c.n * log2(c.a)"),
    ]


def _candidates(text: str) -> str:
    """SQL: array of (start, stop, cell, mark) of the candidates that have an encoding; cell 0 is not random, others are whole `bits`; mark is a hash of the string."""
    none = "cast(array() as array<struct<start:int,kind:int,stop:int,string:string>>)"
    runs = ", ".join(_spans(text, pattern, 3) for pattern in (CANDIDATE, *PIECES))
    found = f"if(rlike({text}, {_lit(CANDIDATE)}), array_distinct(concat({runs})), {none})"
    have = ["start", "stop", "string"]
    for name, value in _battery():
        fields = ", ".join(f"'{h}', c.{h}" for h in have)
        found = f"transform({found}, c -> named_struct({fields}, '{name}', {value}))"
        if name == "alphabet":
            found = f"filter({found}, c -> c.alphabet is not null)"
        have.append(name)
    return f"transform({found}, c -> named_struct('start', c.start, 'stop', c.stop, 'cell', if(c.p < {FLOOR}D, 0, cast(greatest(0, least({CELLS - 1}, floor(c.bits))) as int)), 'mark', xxhash64(c.body)))"


def _threshold(tests: DataFrame, fdr: float) -> int:
    """The smallest cell that is accepted, CELLS if none is. Reads one row per cell.

    A string is one test however often it occurs, so copies of a secret do not lower the bar for others.
    """
    counts = {row.cell: row.n for row in tests.select("cell", "mark").distinct().groupBy("cell").agg(F.count("*").alias("n")).collect()}
    whole, declared, least = sum(counts.values()), 0, CELLS
    for cell in sorted(counts, reverse=True):
        declared += counts[cell]
        if cell and whole * 2.0**-cell <= fdr * declared:
            least = cell
    return least


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = 0.1) -> DataFrame:
    """-> `keep` columns and secret_spans: array of (kind string, start int, stop int), by start, then kind."""
    text = "coalesce(`__text`, '')"
    base = f"concat({_spans(text, ASSIGN, 0, 2, 6)}, {_spans(text, ACCESS, 1)}, {_spans(text, HEX, 2)})"
    bare = docs.select(*keep, F.col(text_col).alias("__text"))
    lean = bare.drop("__text") if text_col not in keep else bare.drop("__text")
    found = stage(bare.select(*lean.columns, F.expr(base).alias("__base"), F.expr(_candidates(text)).alias("__tests")), "secrets")
    free = "filter(`__tests`, c -> not exists(`__base`, b -> b.start < c.stop and c.start < b.stop))"
    found = found.withColumn("__tests", F.expr(free))
    least = _threshold(found.select(F.explode("__tests").alias("t")).select("t.*"), fdr)
    accepted = f"filter(`__tests`, c -> c.cell >= {least})"
    outer = f"transform(array({accepted}), a -> filter(a, c -> not exists(a, d -> d.start <= c.start and c.stop <= d.stop and d.stop - d.start > c.stop - c.start)))[0]"
    added = f"transform({outer}, c -> named_struct('start', c.start, 'kind', 3, 'stop', c.stop))"
    all_spans = f"array_sort(concat(transform(`__base`, b -> named_struct('start', b.start, 'kind', b.kind, 'stop', b.stop)), {added}))"
    names = "array(" + ", ".join(map(_lit, KINDS)) + ")"
    return found.select(*lean.columns, F.expr(f"transform({all_spans}, s -> named_struct('kind', {names}[s.kind], 'start', s.start, 'stop', s.stop))").alias("secret_spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span (overlapping ones together) replaced by `mark`."""
    def step(acc: Column, s: Column) -> Column:
        at, start, stop = acc["at"], s["start"], s["stop"]
        piece = F.concat(F.substring(text, at + 1, F.greatest(start - at, F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(at, stop).alias("at"), F.when(start < at, acc["out"]).otherwise(F.array_append(acc["out"], piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
