"""Weak supervision of text quality: rules vote good or bad or abstain, and a latent-class model weighs them.

Each rule's accuracy is estimated without labels by expectation maximisation over the patterns of votes (3 to the power
of the number of rules at most, whatever the number of documents; only this table of counts leaves the executors). A
document is kept if the posterior probability that it is good is at least `keep_at`, and if it passes the base rules:
20 words or more, and no more than 30 % of them in repeated 8-word windows.

Everything that touches documents is SQL functions; one pass over the texts, and a second shuffle-free pass over their
votes. A null text counts as empty: no words, base_failed, not kept. Rows stay rows. Texts are read whole; windows of a
text are compared by 64-bit hashes. Columns named by `keep` are carried along, no others are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.session import stage

WINDOW = 8
TRUST = (0.6, 0.99)
SPACE = r"[\x20\x09-\x0D]+"
#: name -> (votes bad if, votes good if); otherwise the rule abstains. A symptom's absence is no sign of quality, so rules
#: that look for one symptom never vote good; the last three look at the whole impression and overlap with the others,
#: which is what lets agreement tell their accuracies.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols * 5 > n_words", "false"),
    "repeats": ("n_repeat_words * 10 > 3 * n_words", "false"),
    "capitals": ("n_upper * 2 > n_letters", "false"),
    "lines": ("n_dup_lines * 3 > n_lines", "false"),
    "lengths": ("word_chars < 2 * n_words or word_chars > 14 * n_words", "false"),
    "stops": ("n_stops * 2 > n_words or n_stops = 0 and n_words > 60", "false"),
    "variety": ("n_distinct * 8 < n_words and n_words < 2000", "false"),
    "bars": ("n_bars * 5 > n_words", "false"),
    "sentences": (
        "n_symbols * 5 > n_words or n_upper * 2 > n_letters or n_stops * 2 > n_words or n_distinct * 8 < n_words and n_words < 2000",
        "n_stops between 1 and n_words / 3 and n_upper * 5 < n_letters and n_symbols * 20 < n_words",
    ),
    "fresh": (
        "n_repeat_words * 10 > 3 * n_words or n_symbols * 5 > n_words or n_upper * 2 > n_letters",
        "n_repeat_words * 20 < n_words and n_symbols * 20 < n_words and n_upper * 5 < n_letters and n_words >= 20",
    ),
    "wording": (
        "n_symbols * 5 > n_words or n_repeat_words * 10 > 3 * n_words or n_stops * 2 > n_words",
        "word_chars between 3 * n_words and 9 * n_words and n_symbols * 20 < n_words and n_repeat_words * 20 < n_words",
    ),
}


def measures(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns and the counts that the rules look at."""
    first = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    second = first.select(*keep, "__text", F.filter(F.split("__text", SPACE), lambda w: w != "").alias("__words"))
    codes = F.transform("__words", lambda w: F.xxhash64(w))
    third = second.select("*", codes.alias("__codes"), F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    hashes = F.expr(f"if(size(`__codes`) > {WINDOW}, transform(sequence(1, size(`__codes`) - {WINDOW - 1}), i -> xxhash64(slice(`__codes`, i, {WINDOW}))), cast(array() as array<bigint>))")
    fourth = third.select("*", hashes.alias("__windows"))
    # Positions of windows found twice, in order; then the words that they cover.
    sort = "array_sort(transform(`__windows`, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = f"transform(array({sort}), s -> sort_array(transform(filter(sequence(0, size(s) - 1), k -> s[k].h = s[k - 1].h or s[k].h = s[k + 1].h), k -> s[k].i)))[0]"
    twice = twice.replace("s[k - 1].h", "try_element_at(s, if(k = 0, size(s) + 1, k)).h").replace("s[k + 1].h", "try_element_at(s, k + 2).h")
    covered = f"transform(array({twice}), t -> aggregate(t, named_struct('n', 0L, 'last', -{WINDOW}), (acc, i) -> named_struct('n', acc.n + least({WINDOW}, i - acc.last), 'last', i)).n)[0]"
    repeated = F.expr(f"if(size(array_distinct(`__windows`)) = size(`__windows`), 0L, {covered})")
    length = F.length("__text")

    def count(chars: str) -> Column:
        return (length - F.length(F.translate("__text", chars, ""))).cast("long")

    return fourth.select(
        *keep, F.size("__words").cast("long").alias("n_words"), F.length(F.translate("__text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"), F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), F.regexp_count("__text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        count(".!?").alias("n_stops"), count("|").alias("n_bars"), F.size(F.array_distinct("__codes")).cast("long").alias("n_distinct"),
    )


def fit(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """Posterior of good for every pattern of votes ('g', 'b', '-' per rule).

    A rule that votes is right with its accuracy, which expectation maximisation estimates from the other rules; an
    abstaining rule says nothing. Accuracies stay within `TRUST`, so the classes cannot change their meaning. A document
    without votes has the prior. An empty input gives an empty result.
    """
    if not patterns:
        return {}
    rules, total = range(len(patterns[0][0])), sum(n for _, n in patterns)
    prior, right = 0.8, [0.85] * len(rules)

    def posterior(votes: str) -> float:
        odds = math.log(prior / (1 - prior))
        for k in rules:
            if votes[k] != "-":
                odds += (1 if votes[k] == "g" else -1) * math.log(right[k] / (1 - right[k]))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        chance = [(votes, n, posterior(votes)) for votes, n in patterns]
        prior = min(0.95, max(0.5, sum(n * p for _, n, p in chance) / total))
        for k in rules:
            agreed = sum(n * (p if votes[k] == "g" else 1 - p) for votes, n, p in chance if votes[k] != "-")
            voted = sum(n for votes, n, _ in chance if votes[k] != "-")
            right[k] = min(TRUST[1], max(TRUST[0], (agreed + 8.5) / (voted + 10)))  # ten votes of the starting accuracy
    return {votes: posterior(votes) for votes, _ in patterns}


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), keep_at: float = 0.5) -> DataFrame:
    """-> `keep`, the measures, votes (one letter per rule), quality (posterior), base_failed, kept."""
    votes = F.concat(*(F.expr(f"case when {bad} then 'b' when {good} then 'g' else '-' end") for bad, good in RULES.values()))
    counted = stage(measures(docs, text_col, keep).withColumn("votes", votes), "votes")
    patterns = [(row.votes, row.n) for row in counted.groupBy("votes").agg(F.count("*").alias("n")).collect()]  # 3 ** len(RULES) at most
    table = fit(sorted(patterns))
    listed = ", ".join(f"'{votes}', {value!r}D" for votes, value in sorted(table.items())) or "'', 0D"
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counted.withColumn("quality", F.expr(f"map({listed})[votes]")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
