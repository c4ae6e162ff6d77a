"""OCR text: stripping, pairing and choosing, as expressions within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.schema import OCR_DOC

#: Unicode white space at either end, as Python's str.strip() removes it.
STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_PATTERN, "")


def parse_doc(json: Column) -> Column:
    """An OCR document from JSON; absent or null lists become empty ones."""
    return normal_doc(F.from_json(json, OCR_DOC))


def normal_doc(doc: Column) -> Column:
    texts = F.coalesce(doc.getField("rec_texts"), F.array().cast("array<string>"))
    scores = F.coalesce(doc.getField("rec_scores"), F.array().cast("array<double>"))
    return F.struct(texts.alias("rec_texts"), scores.alias("rec_scores"))


def zip_shortest(texts: Column, scores: Column) -> Column:
    """Pairs (text, score), as many as the shorter list has."""
    n = F.least(F.size(texts), F.size(scores))
    return F.zip_with(
        F.slice(texts, F.lit(1), n),
        F.slice(scores, F.lit(1), n),
        lambda t, s: F.struct(strip(F.coalesce(t, F.lit(""))).alias("text"), s.cast("double").alias("score")),
    )


def nonblank(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p.getField("text") != "")


def best_pair(pairs: Column) -> Column:
    """The first pair with the highest score above 0 and a text; ('', 0.0) if none.

    A fold within the row: no shuffle, and ties go to the first. NaN and null
    scores never win, and blank texts neither.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("score"))

    def better(best: Column, p: Column) -> Column:
        score = p.getField("score")
        wins = (p.getField("text") != "") & ~F.isnan(score) & (score > best.getField("score"))
        return F.when(wins, F.struct(p.getField("text").alias("text"), score.alias("score"))).otherwise(best)

    return F.coalesce(F.aggregate(pairs, start, better), start)


def best_reading(docs: Column) -> Column:
    """best_pair() over all documents of an image, in order; ``docs`` is an array of OCR_DOC."""
    pairs = F.flatten(
        F.transform(
            F.coalesce(docs, F.array().cast(f"array<{OCR_DOC.simpleString()}>")),
            lambda d: zip_shortest(normal_doc(d).getField("rec_texts"), normal_doc(d).getField("rec_scores")),
        )
    )
    return best_pair(pairs)
