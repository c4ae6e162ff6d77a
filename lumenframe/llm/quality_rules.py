"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains. Rows with equal votes form a
pattern; there are at most 3**rules patterns, whatever the corpus.
Expectation-maximisation over the pattern counts of all documents estimates how
often each rule gives each vote on good and on bad documents, and the posterior
probability that a pattern is good replaces all-must-pass filtering: a rule that
turns out to err on good documents is outvoted, one that rarely does decides alone.

Defined results: a null text has no words; documents with no words fail the base
rules; texts of any length are counted whole; of equal lines the first is no
duplicate; repeated rows each get a row; an empty table gives no rows; input
columns other than doc_id and text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialise

#: Words in a window whose repeats count.
WINDOW = 5
#: Rules: name, when it votes good, when it votes bad; else it abstains. They read the columns of text_features().
#: Each kind of damage is seen by more than one of them, so their agreement tells how far each can be trusted.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 20", "n_words < 10"),
    "short_words": ("word_chars >= 4 * n_words", "10 * word_chars < 43 * n_words"),
    "long_words": ("word_chars <= 6 * n_words", "word_chars > 7 * n_words"),
    "single_characters": ("10 * n_single <= 2 * n_words", "10 * n_single > 3 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "specials": ("12 * n_specials <= word_chars", "10 * n_specials > word_chars"),
    "duplicate_lines": ("n_lines >= 2 and n_dup_lines = 0", "5 * n_dup_lines > n_lines"),
    "repeats": ("20 * n_repeat_words <= n_words", "100 * n_repeat_words > 15 * n_words"),
    "adjacent": ("50 * n_adjacent <= n_words", "10 * n_adjacent > n_words"),
    "variety": ("10 * n_distinct >= 6 * n_words", "10 * n_distinct < 3 * n_words"),
    "capitals": ("20 * n_capitals <= word_chars", "10 * n_capitals > word_chars"),
    "punctuation": ("20 * n_marks >= n_words and 2 * n_marks <= n_words", "50 * n_marks < n_words or n_marks > n_words"),
}
#: Rounds of expectation-maximisation.
ROUNDS = 40
#: Where it starts: the share of good documents, and how often a rule votes (bad, none, good) on each class.
PRIOR = 0.8
START_GOOD = (0.02, 0.18, 0.80)
START_BAD = (0.25, 0.25, 0.50)
#: Documents that this belief weighs in each estimate; whatever the corpus, so data decide.
BELIEF = 10.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _covered(windows: Column) -> Column:
    """Words that lie in windows found twice or more, from the hashes of all windows in order."""
    size = F.size(windows)

    def shared(ordered: Column) -> Column:
        same = lambda e, i: F.get(ordered, i).getField("h") == e.getField("h")
        repeated = F.filter(
            ordered,
            lambda e, i: F.coalesce(same(e, i - 1), F.lit(False))
            | F.coalesce(same(e, i + 1), F.lit(False)),
        )
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda e: e.getField("i"))),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda s, i: F.struct(
                (i + WINDOW).alias("end"),
                (s.getField("n") + i + WINDOW - F.greatest(s.getField("end"), i)).alias("n"),
            ),
            lambda s: s.getField("n"),
        )

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < size, let(ordered, shared)).otherwise(0)


def text_features(documents: DataFrame) -> DataFrame:
    """One row of counts per document, within whole-stage projections and without a shuffle.

    Windows are compared by a 64-bit hash of their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    words = documents.select(
        "doc_id",
        text.alias("text"),
        F.array_remove(F.split(spaced, " "), "").alias("w"),
        # capitals, punctuation and symbols, a few characters of each text, found in one pass
        F.regexp_replace(text, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}\p{N}\s]+", "").alias("marks"),
    )
    # Arrays and marks are named several times below, so the optimizer keeps them computed once.
    at = lambda i, k: F.get(F.col("w"), i + k)
    windows = F.when(
        F.size("w") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("w") - WINDOW),
            lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size(F.filter("w", lambda x: F.length(x) == 1)).alias("n_single"),
        F.size(F.filter("w", lambda x, i: F.coalesce(x == at(i, 1), F.lit(False)))).alias("n_adjacent"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit("\t\x0b\x0c\r "))) > 0).alias("lines"),
        "marks",
        windows.alias("h"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    among = lambda chars: F.length("marks") - F.length(_without(F.col("marks"), chars))
    return counted.select(
        "doc_id",
        "n_words",
        long(F.col("word_chars"), "word_chars"),
        long(among("#*$%&|<>"), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(_covered(F.col("h")), "n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_capitals"),
        long(among(".,;:!?"), "n_marks"),
        long(F.length(F.regexp_replace("marks", r"[\p{Lu}\p{Lt}]+", "")), "n_specials"),
        long(F.col("n_single"), "n_single"),
        long(F.col("n_adjacent"), "n_adjacent"),
        long(F.col("n_distinct"), "n_distinct"),
    )


def vote_pattern() -> Column:
    """The votes of all rules as one number in base three; digits 0 bad, 1 none, 2 good."""
    total = F.lit(0)
    for k, (good, bad) in enumerate(RULES.values()):
        vote = F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1)
        total = total + vote * 3**k
    return total.cast("int")


def _rounds(patterns: Column) -> Column:
    """The state (prior, rates on good, rates on bad) after expectation-maximisation."""
    n = len(RULES)
    rule = F.sequence(F.lit(0), F.lit(n - 1))
    cells = F.sequence(F.lit(0), F.lit(3 * n - 1))
    state = lambda prior, good, bad: F.struct(prior.alias("prior"), good.alias("good"), bad.alias("bad"))

    spread = lambda start: F.array(*[F.lit(x) for _ in range(n) for x in start])

    def rates(weighed: Column, weight: Callable[[Column], Column], start: Column) -> Column:
        total = F.aggregate(weighed, F.lit(0.0), lambda a, p: a + weight(p))

        def rate(c: Column, total: Column) -> Column:
            voted = lambda p: F.get(p.getField("v"), F.floor(c / 3).cast("int")) == c % 3
            counted = F.aggregate(
                weighed, F.lit(0.0), lambda a, p: a + F.when(voted(p), weight(p)).otherwise(0.0)
            )
            return (counted + BELIEF * F.get(start, c)) / (total + BELIEF)

        return let(total, lambda t: F.transform(cells, lambda c: rate(c, t)))

    def updated(weighed: Column) -> Column:
        good = F.aggregate(weighed, F.lit(0.0), lambda a, p: a + p.getField("n") * p.getField("q"))
        every = F.aggregate(weighed, F.lit(0.0), lambda a, p: a + p.getField("n"))
        return state(
            (good + BELIEF * PRIOR) / (every + BELIEF),
            rates(weighed, lambda p: p.getField("n") * p.getField("q"), spread(START_GOOD)),
            rates(weighed, lambda p: p.getField("n") * (1 - p.getField("q")), spread(START_BAD)),
        )

    first = state(F.lit(PRIOR), spread(START_GOOD), spread(START_BAD))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        first,
        lambda s, _: let(_posteriors(patterns, s, rule), updated),
    )


def _posteriors(patterns: Column, s: Column, rule: Column) -> Column:
    """The patterns with q, the probability of good; a rule that abstains says nothing."""

    def evidence(p: Column) -> Column:
        def of_rule(j: Column) -> Column:
            vote = F.get(p.getField("v"), j)
            ratio = F.log(F.get(s.getField("good"), 3 * j + vote) / F.get(s.getField("bad"), 3 * j + vote))
            return F.when(vote == 1, 0.0).otherwise(ratio)

        prior = F.log(s.getField("prior") / (1 - s.getField("prior")))
        return F.aggregate(rule, prior, lambda a, j: a + of_rule(j))

    return F.transform(
        patterns,
        lambda p: F.struct(
            p.getField("pattern").alias("pattern"),
            p.getField("n").alias("n"),
            p.getField("v").alias("v"),
            (1 / (1 + F.exp(-evidence(p)))).alias("q"),
        ),
    )


def fit_patterns(votes: DataFrame) -> DataFrame:
    """Rows (pattern, quality) from a table with a column pattern: at most 3**rules rows.

    One aggregation of the whole table, then a fold over the bounded array of
    pattern counts in one row.
    """
    n = len(RULES)
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda j: (F.floor(F.col("pattern") / F.pow(F.lit(3.0), j)) % 3).cast("int"),
    )
    counts = votes.groupBy("pattern").agg(F.count("*").cast("double").alias("n"))
    one = counts.select(F.struct("pattern", "n", digits.alias("v")).alias("p")).agg(
        F.sort_array(F.collect_list("p")).alias("patterns")
    )
    fitted = one.where(F.size("patterns") > 0).select("patterns", _rounds(F.col("patterns")).alias("s"))
    rule = F.sequence(F.lit(0), F.lit(n - 1))
    return fitted.select(
        F.explode(_posteriors(F.col("patterns"), F.col("s"), rule)).alias("p")
    ).select("p.pattern", F.col("p.q").alias("quality"))


def judge_quality(documents: DataFrame, least_quality: float = 0.5) -> DataFrame:
    """Counts, base verdict, posterior quality and kept for every document.

    The counts are written once; the fit reads their patterns and the verdicts
    come back by a broadcast of at most 3**rules rows.
    """
    votes = materialise(
        text_features(documents).withColumn("pattern", vote_pattern()), "quality-votes"
    )
    quality = F.broadcast(fit_patterns(votes))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return votes.join(quality, "pattern").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= least_quality)).alias("kept"),
        "quality",
    )
