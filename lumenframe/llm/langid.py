"""Language identification by a convolutional network over bytes, in numpy.

Bytes fall into 64 symbols, which are embedded and convolved with filters of
several widths; the largest response of each filter in a window, rectified,
feeds a softmax over the languages. Texts are cut into windows of fixed length
that cover them whole; a text's probabilities are the mean of its windows',
weighted by their bytes.

For scoring, embedding and filters fold into lookup tables over symbols and
pairs of symbols, so a response is a sum of a few table rows.

Fitting uses a bounded sample: all windows of ``PER_LANGUAGE`` labelled documents
of each language, of ``SAMPLE_BYTES`` bytes together at most, shared by the
languages, in small batches. Defined results: a null text, or one without
a letter, is ``und`` with score 1; without labelled documents every text is
``und`` with score 0; texts of any length are read whole; rows that repeat have
the same result each and are learned from once; of languages that score the same
the first by code point is taken; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenframe.llm.common import fold, intermediates, materialise, pieces, ship, spin, within_bytes
from lumenframe.llm.textscan import text_buffers

#: Bytes of a window, symbols, width of an embedding, filters of each width, and the widths.
WINDOW, SYMBOLS, EMBEDDING, FILTERS = 128, 64, 8, 16
WIDTHS = (2, 3, 4)
#: Labelled documents of each language and the most languages, which bound the sample; passes over it.
PER_LANGUAGE, MOST_LANGUAGES, EPOCHS = 500, 300, 4
#: Bytes of the sampled texts together, and of one language; texts longer than an eighth of a language's share are not learned from.
SAMPLE_BYTES, LANGUAGE_BYTES = 128 << 20, 8 << 20
#: Windows that are scored at a time.
BATCH = 1024
UNDETERMINED = "und"


def symbol_table() -> np.ndarray:
    """The symbol of each byte: padding, space, digit, other ASCII, 26 letters, 34 for the rest."""
    table = np.full(256, 3, np.uint8)
    table[0], table[[9, 10, 11, 12, 13, 32]] = 0, 1
    table[48:58] = 2
    table[97:123] = table[65:91] = np.arange(4, 30)
    table[128:] = 30 + np.arange(128) % 34
    return table


_SYMBOL = symbol_table()


def cut(text: np.ndarray) -> np.ndarray:
    """A text's symbols as rows of WINDOW, the last one padded."""
    rows = -(-len(text) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(text)] = _SYMBOL[text]
    return out.reshape(rows, WINDOW)


@dataclass
class Network:
    """Parameters: an embedding, filters by width with biases, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, tables and the place where each is read: pairs of symbols, and single ones."""
        out = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embedding @ f[k]).astype(np.float32) for k in range(width)]
            parts = []
            for k in range(0, width - 1, 2):
                pair = single[k][:, None, :] + single[k + 1][None, :, :]
                parts.append((k, np.ascontiguousarray(pair.reshape(SYMBOLS * SYMBOLS, FILTERS))))
            if width % 2:
                parts.append((width - 1, single[width - 1]))
            out.append(parts)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """The softmax of each window."""
        tables, out = self.tables(), []
        for a in range(0, len(windows), BATCH):
            one = windows[a : a + BATCH].astype(np.int32)
            pair = one[:, :-1] * SYMBOLS + one[:, 1:]
            pooled = []
            for width, parts, bias in zip(WIDTHS, tables, self.biases, strict=True):
                places = WINDOW - width + 1
                total = None
                for k, table in parts:
                    source = one if len(table) == SYMBOLS else pair
                    row = table.take(source[:, k : k + places], axis=0)
                    total = row if total is None else np.add(total, row, out=total)
                pooled.append(np.maximum(total.max(axis=1) + bias.astype(np.float32), 0))
            logit = np.concatenate(pooled, axis=1) @ self.weights + self.offset
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            out.append(p / p.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Train by Adam on windows of symbols; classes weigh alike."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    shape = {"e": (SYMBOLS, EMBEDDING), "w": (len(WIDTHS) * FILTERS, n), "o": (n,)}
    for w in WIDTHS:
        shape |= {f"f{w}": (w, EMBEDDING, FILTERS), f"b{w}": (FILTERS,)}
    p = {k: rng.normal(0, 0.3 if k[0] in "ef" else 0.2 if k == "w" else 0.0, s).astype(np.float32) for k, s in shape.items()}
    m, v = ({k: np.zeros(s, np.float32) for k, s in shape.items()} for _ in range(2))
    balance = (len(labels) / (n * np.maximum(1, np.bincount(labels, minlength=n)))).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for chosen in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            x, y = windows[chosen].astype(np.int64), labels[chosen]
            embedded = p["e"][x]
            seen, pooled, tops = [], [], []
            for w in WIDTHS:
                spread = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2)
                spread = np.ascontiguousarray(spread).reshape(len(x), -1, w * EMBEDDING)
                response = spread @ p[f"f{w}"].reshape(w * EMBEDDING, FILTERS) + p[f"b{w}"]
                top = response.argmax(axis=1)
                seen.append(spread)
                tops.append(top)
                pooled.append(np.maximum(np.take_along_axis(response, top[:, None], 1)[:, 0], 0))
            hidden = np.concatenate(pooled, axis=1)
            logit = hidden @ p["w"] + p["o"]
            q = np.exp(logit - logit.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(y)), y] -= 1
            q *= (balance[y] / len(y))[:, None]
            g = {"w": hidden.T @ q + 1e-4 * p["w"], "o": q.sum(axis=0), "e": np.zeros(shape["e"])}
            back = (q @ p["w"].T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                at = np.take_along_axis(seen[k], tops[k][:, :, None], 1)  # text, filter, input
                flat = p[f"f{w}"].reshape(w * EMBEDDING, FILTERS)
                g[f"f{w}"] = np.einsum("bf,bfi->if", part, at).reshape(shape[f"f{w}"])
                g[f"b{w}"] = part.sum(axis=0)
                to_input = (part[:, :, None] * flat.T[None]).reshape(len(x), FILTERS, w, EMBEDDING)
                symbols = np.take_along_axis(x, (tops[k][:, :, None] + np.arange(w)).reshape(len(x), -1), 1)
                symbols, to_input = symbols.ravel(), to_input.reshape(-1, EMBEDDING)
                g["e"] += np.stack([np.bincount(symbols, to_input[:, d], SYMBOLS) for d in range(EMBEDDING)], 1)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["w"], p["o"])


def _learnable(documents: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Documents with a language and a text outside the held-out fold."""
    known = documents.where("lang is not null and text is not null and doc_id is not null")
    return known.where(fold(F.col("doc_id"), modulus) != held_out)


def _sampled_windows(documents: DataFrame, modulus: int, held_out: int, most: int = LANGUAGE_BYTES) -> DataFrame:
    """Rows (lang, windows): all windows of each sampled document; ids are drawn by a hash, of a language at most ``most`` bytes of text."""
    known = _learnable(documents, modulus, held_out)
    # A hash threshold from each language's count leaves a few thousand ids of any language before they are ranked.
    counts = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("many")))
    few = known.select("doc_id", "lang", spin(F.col("doc_id")).alias("spin")).join(counts, "lang").where(F.col("spin") * F.col("many") < 4 * PER_LANGUAGE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spin", "doc_id"))
    ids = few.withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE).select("doc_id", "lang").distinct()
    picked = documents.where("text is not null").select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])
    picked = within_bytes(materialise(picked, "language-sample"), "lang", most)

    def pick(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            data, at = text_buffers(batch.column("text"))
            windows = [cut(data[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(windows, pa.binary())], ["lang", "windows"])

    return picked.select("lang", "text").mapInArrow(pick, "lang string, windows binary")


def language_model(documents: DataFrame, modulus: int = 4, held_out: int = 2) -> Network | None:
    """The network for the languages of documents outside the held-out fold; None if there are none."""
    many = _learnable(documents, modulus, held_out).select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if many > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = min(LANGUAGE_BYTES, SAMPLE_BYTES // max(1, many))
    with intermediates():
        found = _sampled_windows(documents, modulus, held_out, share).collect()
    rows = sorted({(r.lang, bytes(r.windows)) for r in found if r.windows})
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([languages.index(lang) for lang, _ in rows], [len(w) // WINDOW for _, w in rows])
    return train(windows, labels, languages)


def identify(texts, network: Network | None) -> tuple[list[str], list[float]]:
    """The language of each row of an Arrow string column and its probability."""
    data, at = text_buffers(texts)
    ascii_letter = (_SYMBOL >= 4) & (_SYMBOL < 30)
    letters = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    plain = letters[at[1:]] > letters[at[:-1]]
    pieces = [cut(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    counts = np.array([len(p) for p in pieces])
    if network is not None and counts.sum():
        p = network.probabilities(np.concatenate(pieces))
        ends = np.cumsum(counts)
        mass = np.full(len(p), WINDOW, float)
        full = counts > 0
        mass[ends[full] - 1] = (np.diff(at)[full] - 1) % WINDOW + 1
        total = np.zeros((len(counts), p.shape[1]))
        np.add.at(total, np.repeat(np.arange(len(counts)), counts), p * mass[:, None])
    names, scores = [], []
    for k in range(len(counts)):
        known = plain[k] or any(c.isalpha() for c in bytes(data[at[k] : at[k + 1]]).decode("utf-8", "replace"))
        if not known or network is None:
            names.append(UNDETERMINED)
            scores.append(0.0 if known else 1.0)
        else:
            share = total[k] / total[k].sum()
            names.append(network.languages[int(share.argmax())])
            scores.append(float(share.max()))
    return names, scores


def predict_language(documents: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every document, without a shuffle."""
    fitted = ship(documents.sparkSession, network)
    schema = T.StructType([documents.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        import pyarrow as pa

        here = fitted()
        for batch in pieces(batches):
            names, scores = identify(batch.column("text"), here)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return documents.select("doc_id", "text").mapInArrow(predict, schema)
