"""A toxicity classifier regularised by counterfactuals.

Texts become sets of hashed word features: each word, and its first bytes in
several lengths, so invented and inflected words share evidence. A logistic
model is trained on labelled texts. In labelled texts that name a group, every
identity term is swapped for another of its kind; in those that name none, terms
of a kind are set into a place of the text that a hash of it picks. The squared
change of the model's logit is penalised, so naming a group by itself does not
raise a score, nor does a term that begins like an insult.

Fitting uses a bounded sample (``per_class`` documents of each label, whole
texts). Spark counts the documents of each feature and picks those that tell the
labels apart; only these, for each sampled text, reach the driver. As few sampled
texts may name a group, up to GROUP_SAMPLE labelled documents that do are added
for the penalty alone: they are no sample of the labels, so they take no part in
the loss. Scoring hashes every word of every text in the tasks that read it,
without a shuffle, and looks up the few features kept.

Defined results: null and empty texts have no features and the score of that; a
text of any length is scored whole; repeated rows have the same score each, and of
labelled documents that share an id the least text is learned from; ids in labels
without a document and null labels are ignored; without labels of both classes
every score is the share of toxic labels, or 0.5 without any; an empty table gives
no rows; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import discard, fold, labelled_sample, materialise, pieces, ship, spin
from lumenframe.llm.textscan import WordScanner, mix, text_buffers

#: Labelled documents of each class that are used for fitting.
PER_CLASS = 2000
#: Labelled documents that name a group, outside the held-out fold, which are added for the penalty.
GROUP_SAMPLE = 300
#: Tasks that work on the sampled texts.
SAMPLE_TASKS = 16
#: Terms of a kind that are set, one at a time, into a text that names no group.
PLACED = 2
#: Lengths of word beginnings that are features, in bytes.
PREFIXES = (3, 4, 5, 6)
#: Documents of the sample that must have a feature, standard errors by which its log odds must differ, and features kept.
LEAST_DOCUMENTS, LEAST_STRENGTH, MOST_FEATURES = 3, 3.0, 5000
#: Weights of the ridge and of the counterfactual penalty, and of toxic texts against others, whatever their numbers.
#: The last was picked by ten-fold cross-validation on sf0.1's learnable rows: recall 0.895, 0.908, 0.918 and 0.925 at
#: 1, 2, 3 and 4, with 6, 9, 15 and 17 of 2,331 others marked; more than 2 raises neutral mentions of groups too far.
RIDGE, PENALTY, TOXIC_WEIGHT = 3e-5, 1.0, 2.5
#: Terms that name groups of people, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "gender": ["men", "women", "nonbinary", "transgender"],
    "person": ["man", "woman", "boy", "girl"],
    "orientation": ["gay", "lesbian", "bisexual", "straight"],
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "believers": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    "descent": ["african", "asian", "european", "latino", "arab"],
    "colour": ["black", "white", "brown"],
    "age": ["young", "old", "elderly"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
    "gender, German": ["männer", "frauen"],
    "believers, German": ["christen", "muslime", "juden", "buddhisten", "atheisten"],
    "gender, French": ["hommes", "femmes"],
    "believers, French": ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
    "gender, Spanish": ["hombres", "mujeres"],
    "believers, Spanish": ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
}


def term_pattern(terms: dict[str, list[str]]) -> str:
    """Matches a term, in Python and in Spark."""
    return r"(?i)\b(" + "|".join(sorted({t for kind in terms.values() for t in kind}, key=lambda t: (-len(t), t))) + r")\b"


def swap_identities(text: str, places: Iterable[int] | None = (1, 2), terms: dict[str, list[str]] = IDENTITY_TERMS) -> list[str]:
    """The text with every identity term moved on by each of ``places`` among its kind; none if it names no group.

    Without ``places`` by one, two ... up to the last of the largest kind named, so each term meets all others of its
    kind. A term of several kinds is taken as of the first.
    """
    pattern = term_pattern(terms)
    kinds = {t: (kind, k) for kind in reversed(terms.values()) for k, t in enumerate(kind)}
    named = {t.lower() for t in re.findall(pattern, text)}
    if not named:
        return []
    if places is None:
        places = range(1, max(len(kinds[t][0]) for t in named))

    def moved(match, by: int) -> str:
        kind, k = kinds[match[0].lower()]
        return kind[(k + by) % len(kind)]

    return [re.sub(pattern, lambda m, by=by: moved(m, by), text) for by in places]


def place_identities(text: str, many: int = PLACED, terms: dict[str, list[str]] = IDENTITY_TERMS) -> list[str]:
    """The text with one of ``many`` terms of a kind set between two of its words; a hash of the text picks kind and place."""
    pick = zlib.crc32(text.encode())
    kind = list(terms.values())[pick % len(terms)]
    gaps = [m.end() for m in re.finditer(r"(?<=\S)\s", text)] or [0]
    at = gaps[(pick >> 8) % len(gaps)]
    first = (pick >> 16) % len(kind)
    return [f"{text[:at]}{kind[(first + k) % len(kind)]} {text[at:]}" for k in range(min(many, len(kind)))]


def counterfactuals(text: str, terms: dict[str, list[str]] = IDENTITY_TERMS) -> list[str]:
    """The text's versions with other groups named: swapped terms, or placed ones if it names none; none if it is empty."""
    return swap_identities(text, None, terms) or (place_identities(text, PLACED, terms) if text.strip() else [])


class Features:
    """The hashed features of texts: words and their beginnings, with the index of their text."""

    def __init__(self):
        self.scanner = WordScanner("alnum", PREFIXES)

    def __reduce__(self):
        return Features, ()

    def of(self, column) -> tuple[list[np.ndarray], np.ndarray]:
        """An array of features of all words for each kind, and for each text its first word's index."""
        words, heads, first = self.scanner.scan(*text_buffers(column))
        kinds = [words, *heads]
        return [mix(h + np.uint64((k + 1) << 56)) for k, h in enumerate(kinds)], first

    def sets(self, column) -> list[np.ndarray]:
        """The distinct features of each text."""
        kinds, first = self.of(column)
        return [np.unique(np.concatenate([k[a:b] for k in kinds])) for a, b in zip(first[:-1], first[1:], strict=True)]


@dataclass
class ToxicityModel:
    """Weights of the kept features, sorted by feature."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def scores(self, column, features: Features) -> np.ndarray:
        """The probability of toxic for each text: the logit is the sum of its distinct features' weights."""
        kinds, first = features.of(column)
        n = len(first) - 1
        logit = np.full(n, self.intercept)
        if not len(self.features):
            return 1 / (1 + np.exp(-logit))
        shift = np.uint64(64 - 20)
        may = np.zeros(1 << 20, bool)
        may[(self.features >> shift).astype(np.int64)] = True
        found = []
        for hashes in kinds:
            at = np.flatnonzero(may[(hashes >> shift).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.features, hashes[at]), len(self.features) - 1)
            hit = self.features[place] == hashes[at]
            doc = np.searchsorted(first, at[hit], "right") - 1
            found.append(doc * len(self.features) + place[hit])
        pairs = np.unique(np.concatenate(found))
        doc, place = np.divmod(pairs, len(self.features))
        logit += np.bincount(doc, self.weights[place], minlength=n)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def strongest(sets: list[np.ndarray], labels: np.ndarray, z: float = LEAST_STRENGTH, most: int = MOST_FEATURES) -> np.ndarray:
    """The features whose log odds differ between the labels by ``z`` standard errors, the ``most`` strongest of them, sorted."""
    everything, place = np.unique(np.concatenate(sets), return_inverse=True)
    texts = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odds, spread, many = [], 0.0, 0
    for y in (0, 1):
        found = np.bincount(place[labels[texts] == y], minlength=len(everything))
        have, many = found + 0.5, many + found
        lack = (labels == y).sum() + 1 - have
        odds.append(np.log(have / lack))
        spread = spread + 1 / have + 1 / lack
    strength = np.where(many >= LEAST_DOCUMENTS, np.abs(odds[1] - odds[0]) / np.sqrt(spread), -1)
    order = np.lexsort((everything.astype(np.int64), -strength))[:most]
    return np.sort(everything[order[strength[order] >= z]])


def train(
    sets: list[np.ndarray],
    labels: np.ndarray,
    weight: np.ndarray,
    swapped: list[tuple[int, np.ndarray]],
    penalty: float = PENALTY,
    z: float = LEAST_STRENGTH,
    most: int = MOST_FEATURES,
    ridge: float = RIDGE,
    rounds: int = 300,
    kept: np.ndarray | None = None,
) -> ToxicityModel:
    """Minimise weighted log loss + ridge + penalty * mean squared change of the logit of swapped texts.

    ``swapped``: pairs of a text's index and the features of one of its swapped
    versions. Texts with the label -1 and no weight serve the penalty only. The
    features are ``kept``, sorted, or those that strongest() picks. Full-batch
    gradient steps with adaptive scaling (Adam).
    """
    n = len(sets)
    if kept is None:
        kept = strongest([sets[i] for i in np.flatnonzero(labels >= 0)], labels[labels >= 0], z, most)

    def sparse(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(kept):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(kept, flat), len(kept) - 1)
        hit = kept[at] == flat
        return row[hit], at[hit]

    row, col = sparse(sets)
    new_row, new_col = sparse([s for _, s in swapped])
    origin = np.array([i for i, _ in swapped], np.int64)
    w, bias = np.zeros(len(kept)), 0.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    mass = weight.sum()
    for step in range(1, rounds + 1):
        logit = bias + np.bincount(row, w[col], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) / mass
        slope = np.bincount(col, error[row], minlength=len(kept)) + ridge * w
        if len(origin):
            change = bias + np.bincount(new_row, w[new_col], minlength=len(origin)) - logit[origin]
            pull = 2 * penalty * change / len(origin)
            slope += np.bincount(new_col, pull[new_row], minlength=len(kept))
            back = np.bincount(origin, pull, minlength=n)
            slope -= np.bincount(col, back[row], minlength=len(kept))
        full = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel(kept, w, float(bias))


def group_sample(documents: DataFrame, labels: DataFrame, modulus: int, held_out: int, terms: dict[str, list[str]] = IDENTITY_TERMS) -> DataFrame:
    """(doc_id, text, label -1) of at most GROUP_SAMPLE labelled documents outside the held-out fold that name a group, by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), modulus) != held_out)
    named = documents.where(F.col("text").rlike(term_pattern(terms))).select("doc_id").join(known.select("doc_id"), "doc_id", "left_semi")
    picked = named.distinct().orderBy(spin(F.col("doc_id")), "doc_id").limit(GROUP_SAMPLE)
    found = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("label", F.lit(-1))


def _feature_counts(sample: DataFrame, features: Features) -> DataFrame:
    """(feature, n0, n1): how many sampled texts of each label have it; a row for each feature of some hundred texts."""

    def count(batches):
        import pyarrow as pa

        for batch in pieces(batches, 200, 2 << 20):
            sets = features.sets(batch.column("text"))
            label = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), [len(s) for s in sets])
            found, place = np.unique(np.concatenate(sets), return_inverse=True)
            many = [np.bincount(place[label == y], minlength=len(found)) for y in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, many)], ["feature", "n0", "n1"])

    return sample.select("text", "label").mapInArrow(count, "feature long, n0 long, n1 long")


def _strongest(counts: DataFrame, many: dict[int, int]) -> np.ndarray:
    """strongest() by Spark, from the rows of _feature_counts() and the number of texts of each label."""
    counts = counts.groupBy("feature").agg(*[F.sum(f"n{y}").alias(f"n{y}") for y in (0, 1)])
    have = [F.col(f"n{y}") + 0.5 for y in (0, 1)]
    lack = [F.lit(many.get(y, 0) + 1) - have[y] for y in (0, 1)]
    strength = F.abs(F.log(have[1] / lack[1]) - F.log(have[0] / lack[0])) / F.sqrt(1 / have[0] + 1 / lack[0] + 1 / have[1] + 1 / lack[1])
    strong = counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS).select("feature", strength.alias("strength")).where(F.col("strength") >= LEAST_STRENGTH)
    best = strong.orderBy(F.desc("strength"), "feature").limit(MOST_FEATURES).collect()
    return np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))


def _version_rows(sample: DataFrame, features: Features, terms: dict[str, list[str]], kept: np.ndarray) -> DataFrame:
    """(doc_id, label, version, places) of the sampled texts and their versions: places in ``kept`` as bytes of 32-bit integers, since they go to the driver."""
    schema = T.StructType(
        [sample.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("version", T.IntegerType()), T.StructField("places", T.BinaryType())]
    )

    def describe(batches):
        import pyarrow as pa

        for batch in pieces(batches, 50):
            texts, at, version = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                every = [text or "", *counterfactuals(text or "", terms)]
                texts += every
                at += [k] * len(every)
                version += range(len(every))
            sets = features.sets(pa.array(texts, pa.string()))
            places = pa.array([np.flatnonzero(np.isin(kept, s)).astype(np.int32).tobytes() for s in sets], pa.binary())
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(place), batch.column("label").take(place).cast(pa.int32()), pa.array(version, pa.int32()), places],
                schema.names,
            )

    return sample.select("doc_id", "text", "label").mapInArrow(describe, schema)


def toxicity_model(
    documents: DataFrame,
    labels: DataFrame,
    modulus: int = 3,
    held_out: int = 1,
    per_class: int = PER_CLASS,
    terms: dict[str, list[str]] = IDENTITY_TERMS,
    penalty: float = PENALTY,
) -> ToxicityModel:
    """The model of ``labels.toxic`` from documents outside the held-out fold.

    ``terms`` names groups by kind, in whatever languages the texts have.
    """
    import pyarrow as pa

    features = Features()
    drawn, shares = labelled_sample(documents, labels, "toxic", modulus, held_out, per_class)
    # a small sample would come from one task, and its features from one as well
    sample = materialise(drawn.repartition(SAMPLE_TASKS), "toxic-sample")
    many = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    kept = _strongest(_feature_counts(sample, features), many)
    # the terms' own features have weights too, for texts that name groups
    named = features.sets(pa.array([" ".join(t for kind in terms.values() for t in kind)], pa.string()))[0]
    kept = np.unique(np.concatenate([kept, named]))
    groups = group_sample(documents, labels, modulus, held_out, terms).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    # written by tasks side by side, then brought to the driver a partition at a time
    every = sample.unionByName(groups).repartition(SAMPLE_TASKS)
    found = materialise(_version_rows(every, features, terms, kept), "toxic-versions")
    rows = [(r.doc_id, r.label, r.version, kept[np.frombuffer(r.places, np.int32)]) for r in found.toLocalIterator()]
    discard(sample, found)
    return fit_toxicity(rows, shares, penalty, kept)


def fit_toxicity(
    rows: list[tuple[object, int, int, np.ndarray]], shares: dict[int, int], penalty: float = PENALTY, kept: np.ndarray | None = None
) -> ToxicityModel:
    """Fit on (id, label, version, features), version 0 being the text itself; ``kept`` are the features used, if already picked.

    ``shares`` are the labels' counts outside the held-out fold before sampling, for
    the score where one class is missing. Rows with the label -1 take part in the penalty, not in the loss.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    own = [r for r in rows if r[2] == 0]
    labels = np.array([r[1] for r in own], float)
    if len(set(labels.tolist()) - {-1}) < 2 or (kept is None and not sum(len(r[3]) for r in own if r[1] >= 0)):
        share = (shares.get(1, 0) + 0.5) / (shares.get(0, 0) + shares.get(1, 0) + 1)
        return ToxicityModel(intercept=float(np.log(share / (1 - share))))
    index = {r[0]: k for k, r in enumerate(own)}
    swapped = [(index[r[0]], r[3]) for r in rows if r[2] > 0]
    # classes weigh by a ratio of their own, so rare toxic texts aren't missed for the many others
    weight = np.where(labels == 1, 0.5 * TOXIC_WEIGHT / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    weight = np.where(labels < 0, 0.0, weight)
    return train([r[3] for r in own], labels, weight, swapped, penalty, kept=kept)


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every document."""
    fitted = ship(documents.sparkSession, model)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("score", T.DoubleType())])
    features = Features()

    def score(batches):
        import pyarrow as pa

        here = fitted()
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(here.scores(batch.column("text"), features))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(score, schema)
