"""A quality classifier made of two compression dictionaries.

One zstandard dictionary is built from good, one from bad labelled texts. A text
is compressed in small blocks with each; the difference of the two sizes over
their sum says which class it resembles. Logistic calibration on labelled texts
that neither dictionary has seen turns that into the probability of good; it
also reads how far the text was compressed, since a text that repeats itself
compresses alike with any dictionary.

Fitting uses a bounded sample (``per_class`` documents of each label, whole texts,
of at most ``CLASS_BYTES`` bytes together). Scoring compresses every block of every text in the tasks that read it,
without a shuffle.

Defined results: null and empty texts have a difference of 0 and the score of
that; texts of any length are compressed whole, block by block; rows that repeat
have the same score each, and of labelled documents that share an id the least
text is learned from; ids in labels without a document are ignored; null labels too; without
labelled texts of both classes every score is the share of good labels, or 0.5
without any; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenframe.llm.common import discard, labelled_sample, materialise, pieces, ship, within_bytes

#: Labelled documents of each class that are used for fitting, and their bytes together; longer ones than an eighth of
#: that are not learned from.
PER_CLASS, CLASS_BYTES = 3000, 32 << 20
#: Bytes that are compressed on their own, the compression level, and bytes of a dictionary.
BLOCK, LEVEL, DICTIONARY = 1024, 3, 112_640
#: Bytes of the smallest dictionary that is tried, where there is too little text to train a larger one.
LEAST_DICTIONARY = 256


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on all blocks, of half the size as often as they are too few for more.

    Where even LEAST_DICTIONARY bytes can't be trained, on a handful of blocks, these are the dictionary.
    """
    import zstandard

    blocks, size = [b for t in texts for b in blocks_of(t)], DICTIONARY
    while size >= LEAST_DICTIONARY:
        try:
            return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(blocks)


@dataclass
class QualityModel:
    """Two dictionaries and the calibration of their difference."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def compressors(self) -> tuple:
        import zstandard

        out = []
        for data in (self.good, self.bad):
            kind = zstandard.ZstdCompressionDict(data)
            kind.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_dict_id=False))
        return tuple(out)

    def measures(self, texts: list[bytes]) -> np.ndarray:
        """For each text (bad - good) / (bad + good) of its compressed sizes and the log of their share of its size.

        An empty text has 0 and 0.
        """
        out = np.zeros((len(texts), 2))
        if not (self.good and self.bad):
            return out
        good, bad = (c.compress for c in self.compressors())
        for k, text in enumerate(texts):
            a = b = 0
            for block in blocks_of(text):
                a += len(good(block))
                b += len(bad(block))
            if text:
                out[k] = (b - a) / (a + b), np.log((a + b) / (2 * len(text)))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit = design(self.measures(texts)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def design(measures: np.ndarray) -> np.ndarray:
    """The calibration's inputs: one, the difference, and the compression and its square."""
    difference, packed = measures.T
    return np.column_stack([np.ones(len(measures)), difference, packed, packed**2])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a small ridge, by Newton steps."""
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    x = x / scale
    ridge = 1e-2 * np.eye(x.shape[1])
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weight * (p - y)) + ridge @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((beta / scale).tolist())


def fit_quality(rows: list[tuple[int, str | None, int]], shares: dict[int, int]) -> QualityModel:
    """Fit on (id, text, label); ``shares`` are the labels' counts outside the held-out fold before sampling, for the prior.

    Every other document builds the dictionaries, the rest calibrate.
    """
    rows = sorted(rows)
    data = [((t or "").encode(), y) for _, t, y in rows]
    build, rest = data[::2], data[1::2]
    total = sum(shares.values())
    if min((sum(y == k for _, y in part) for part in (build, rest) for k in (0, 1)), default=0) < 1:
        share = (shares.get(1, 0) + 0.5) / (total + 1)
        return QualityModel(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    model = QualityModel(*(build_dictionary([t for t, y in build if y == k]) for k in (1, 0)), ())
    y = np.array([y for _, y in rest], float)
    weight = np.where(y == 1, shares.get(1, 0) / (y == 1).sum(), shares.get(0, 0) / (y == 0).sum())
    model.weights = calibrate(design(model.measures([t for t, _ in rest])), y, weight * len(y) / total)
    return model


def quality_model(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> QualityModel:
    """The model of ``labels.quality`` from documents outside the held-out fold."""
    drawn, shares = labelled_sample(documents, labels, "quality", modulus, held_out, per_class)
    sample = materialise(drawn, "quality-sample")
    rows = within_bytes(sample, "label", CLASS_BYTES).select("doc_id", "text", "label").collect()
    discard(sample)
    return fit_quality([tuple(r) for r in rows], shares)


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every document."""
    fitted = ship(documents.sparkSession, model)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batches):
        import pyarrow as pa

        here = fitted()
        for batch in pieces(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(here.scores(texts))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(score, schema)


def keep_good(documents: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``documents`` whose score is at least ``least``, judged where they lie."""
    fitted = ship(documents.sparkSession, model)
    at = documents.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        here = fitted()
        for batch in pieces(batches):
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(here.scores(texts) >= least))

    return documents.mapInArrow(keep, documents.schema)
