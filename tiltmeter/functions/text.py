"""Column helpers for text: normalising, tag lists, topics and answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# One quoted token or number of a list literal. Possessive repeats keep the matcher from recursing on long text.
_QUOTED = r"'(?:[^'\\]++|\\.)*+'|" + r'"(?:[^"\\]++|\\.)*+"'
_ITEM = rf"(?:{_QUOTED}|[+-]?\d++(?:\.\d*+)?)"
_LIST_LITERAL = rf"(?s)^(?:\[\s*+\]|\(\s*+\)|\[\s*+{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+,?\s*+\]|\(\s*+{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+,?\s*+\))$"
_SCALAR_LITERAL = rf"(?s)^(?:{_QUOTED})$"
_NUMBER_LITERAL = r"^[+-]?\d++(?:\.\d*+)?$"


def as_col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# What Python counts as whitespace: the Unicode property plus four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]+"


# Matches a text that is more than whitespace.
HAS_TEXT = r"(?U)[^\s\x1c-\x1f]"


def strip(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), rf"(?U)^{_SPACE}|{_SPACE}$", "")


def normalize_text(col: Column | str) -> Column:
    """Null becomes empty; every run of whitespace becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(col), F.lit("")), rf"(?U){_SPACE}", " "))


def _unquote(token: Column) -> Column:
    quoted = token.rlike(r"""(?s)^(['"]).*\1$""")
    inner = F.regexp_replace(F.substring(token, F.lit(2), F.length(token) - 2), r"""\\(['"\\])""", "$1")
    return F.when(quoted, inner).otherwise(token)


def parse_tags(col: Column | str) -> Column:
    """A tag field as a list of strings.

    Accepts a list literal (`['a', 'b']`), one quoted string, or plain text split on commas. A field that is
    a bare number holds no tags.
    """
    raw = strip(F.coalesce(as_col(col), F.lit("")))
    listed = F.transform(F.regexp_extract_all(raw, F.lit(f"({_ITEM})"), 1), _unquote)
    tags = (
        F.when(raw.rlike(_LIST_LITERAL), listed)
        .when(raw.rlike(_SCALAR_LITERAL), F.array(_unquote(raw)))
        .when(raw.rlike(_NUMBER_LITERAL), F.array().cast("array<string>"))
        .otherwise(F.split(raw, ","))
    )
    return F.filter(F.transform(tags, strip), lambda tag: tag != "")


def detect_topics(tags: Column, text: Column, topics: Mapping[str, Sequence[str]]) -> Column:
    """Symbols named by the tags or, as whole words, by the text; in the order of `topics`."""
    plain = F.transform(tags, lambda tag: F.regexp_replace(F.lower(tag), "^#+", ""))

    def found(low: Column) -> Column:
        hits = []
        for symbol, words in topics.items():
            aliases = F.array(*[F.lit(w.lower()) for w in words])
            # A plain substring search rules out most texts before the pattern runs.
            maybe = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])
            whole = low.rlike(r"(?U)(?<!\w)(?:" + "|".join(rf"\Q{w.lower()}\E" for w in words) + r")(?!\w)")
            hits.append(F.when(F.arrays_overlap(plain, aliases) | (maybe & whole), F.lit(symbol)))
        return F.array_compact(F.array(*hits))

    # Bound as a lambda variable, the lower-cased text is made once per row.
    return F.transform(F.array(F.lower(text)), found)[0]


def tag_symbol(tags: Column, symbols: Mapping[str, str], default: str) -> Column:
    """Symbol of the first tag that has one."""
    pairs = [F.lit(part) for item in symbols.items() for part in item]
    lookup = F.create_map(*pairs)
    found = F.filter(F.transform(tags, lambda tag: lookup[strip(F.lower(tag))]), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default))


def first_keyword(text: Column, keywords: Sequence[tuple[str, str]], default: str) -> Column:
    """Value of the first keyword, in priority order, that the lower-cased text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    result = None
    for word, value in keywords:
        condition = F.contains(low, F.lit(word))
        result = F.when(condition, F.lit(value)) if result is None else result.when(condition, F.lit(value))
    return result.otherwise(F.lit(default))


def answer_action(text: Column | str) -> Column:
    """Action named in a free-text answer, looking only after the last `Answer:`."""
    tail = F.substring_index(as_col(text), "Answer:", -1)
    return first_keyword(tail, [("buy", "BUY"), ("sell", "SELL"), ("hold", "HOLD")], "HOLD")


def answer_sentiment(text: Column | str) -> Column:
    return first_keyword(as_col(text), [("positive", "positive"), ("negative", "negative")], "neutral")
