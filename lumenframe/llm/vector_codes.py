"""Vector codes by product quantisation, fitted and assigned in exact integers.

Components become integers, vectors are cut into equal parts, and every part gets
the index of its nearest codebook entry. A part's nearest entry is screened by a
float32 matrix product with a rounding-error interval that holds in any order of
summation; every entry whose interval reaches the best one's is evaluated again in
int64, and the least index of the exactly nearest wins, so results don't depend on
the machine.

With u = 2**-24, n components, x a part and c an entry as exact integers, rounding
both to float32, the product of length n, the entry's square and the difference
put ``c.c - 2 x.c`` off by less than ``(n + 8) * 2 * u * (c.c + 2 |x| |c|)`` for
n below 2**20; ``_screen`` takes the largest over the entries as every entry's.

The table is read once for each round and once for the codes; tasks give sums and
counts for each entry, and the driver sees the codebooks only, whatever the rows.

Defined results: rows whose vector is null, or holds a null, NaN or infinite
component, are dropped, and empty vectors too; vectors of unequal length, of a
length that the parts don't divide, or with components of 2**26 or more as
integers (whose squares could leave 64 bits) give an error; null ids are coded but
never begin a codebook; rows that repeat an id are rows of their own, and of those
the one with the lesser vector begins codebooks first; with fewer rows than entries
the codebooks are as large as the rows; equal distances go to the lower index; an
empty table gives no rows; only vec_id, embedding and label are read, so further
columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import MOST_BROADCAST, materialise, pieces, ship

#: What components are multiplied by before they are rounded down, and the bound of the result.
SCALE, MOST_COMPONENT = 1024, 1 << 26
#: Parts of a vector, entries of a codebook, and rounds of the fit.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows whose distances to all entries stand in memory at once, and pairs that are evaluated exactly at once.
ROWS, EXACT = 4096, 1 << 17
#: A label with at least one of so many rows is hot: its sum is broadcast, and there can't be more such labels than this.
HOT = 100_000


@dataclass(frozen=True)
class Codebooks:
    """For each part the entries, as integers of shape (parts, entries, part length)."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of an Arrow column of vectors as integers, and their positions."""
    import pyarrow as pa

    size = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(size)
    kept = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
    if not len(kept):
        return np.zeros((0, 0), np.int64), kept
    if len(np.unique(size[kept])) > 1:
        raise ValueError("vectors have different lengths")
    mine = np.repeat(np.isin(np.arange(len(size)), kept), size)
    scaled = np.floor(values[mine] * SCALE)
    if np.abs(scaled).max(initial=0) >= MOST_COMPONENT:
        raise ValueError(f"a component of {MOST_COMPONENT // SCALE} or more")
    return scaled.astype(np.int64).reshape(len(kept), -1), kept


def _screen(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, entry), in this order, that rounding errors leave as possibly nearest."""
    n = entries.shape[1]
    squares = (entries * entries).sum(1)
    scores = x.astype(np.float32) @ (-2 * entries.T).astype(np.float32)
    scores += squares.astype(np.float32)
    lengths = np.sqrt((x * x).sum(1).astype(np.float64))
    error = (n + 8) * 2.0**-23 * (squares.max() + 2 * lengths * np.sqrt(float(squares.max())))
    # rounded up once more, as the sum below is in float32
    reach = np.nextafter((scores.min(1) + 2 * error + 2.0**-22 * np.abs(scores).max(1)).astype(np.float32), np.float32(np.inf))
    return np.nonzero(scores <= reach[:, None])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the least index of the nearest entry, and the squared distance."""
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        row, entry = _screen(part, entries)
        exact = np.empty(len(row), np.int64)
        for k in range(0, len(row), EXACT):
            apart = part[row[k : k + EXACT]] - entries[entry[k : k + EXACT]]
            exact[k : k + EXACT] = (apart * apart).sum(1)
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, begins)
        at = np.flatnonzero(exact == np.repeat(least, np.diff(begins, append=len(row))))
        first = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
        index[a : a + ROWS], distance[a : a + ROWS] = entry[first], least
    return index, distance


def _usable(vectors: DataFrame) -> DataFrame:
    """The rows that are kept, told by built-in expressions."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", odd))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the rows with the least ids, ascending; None without rows. At most ``entries`` rows reach the driver."""
    import pyarrow as pa

    usable = _usable(vectors)
    first = usable.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "embedding").limit(entries).collect()
    if not first:
        return None
    x, _ = integer_vectors(pa.array([r.embedding for r in first], pa.list_(pa.float64())))
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} parts")
    return Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy())


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (part, entry, n, s0, s1, ...): how many parts are nearest to an entry, and their sums; a few rows a task."""
    parts, _, width = books.entries.shape
    sent = ship(vectors.sparkSession, books.entries)
    names = ["part", "entry", "n", *[f"s{k}" for k in range(width)]]

    def add(batches):
        import pyarrow as pa

        entries = sent()
        count = np.zeros(entries.shape[:2], np.int64)
        total = np.zeros_like(entries)
        for batch in pieces(batches, rows=ROWS):
            x, _ = integer_vectors(batch.column("embedding"))
            for p in range(parts if len(x) else 0):
                mine = _part(x, p, entries)
                index, _ = nearest(mine, entries[p])
                count[p] += np.bincount(index, minlength=entries.shape[1])
                np.add.at(total[p], index, mine)
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return vectors.select("embedding").mapInArrow(add, ", ".join(f"{c} long" for c in names))


def _part(x: np.ndarray, p: int, entries: np.ndarray) -> np.ndarray:
    """Part ``p`` of the rows; rows of another length than the codebooks' are an error."""
    parts, _, width = entries.shape
    if x.shape[1] != parts * width:
        raise ValueError("vectors have different lengths")
    return np.ascontiguousarray(x[:, p * width : (p + 1) * width])


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` of assigning all rows and replacing entries by the floored means of theirs."""
    books = first_codebooks(vectors, parts, entries)
    if books is None:
        return None
    for _ in range(rounds):
        width = books.entries.shape[2]
        sums = _sums(vectors, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
        fresh = books.entries.copy()
        for r in sums.collect():  # at most a row for each entry
            fresh[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
        books = Codebooks(fresh)
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, code, error): hexadecimal indexes in the order of parts, and the summed squared distances."""
    sent = ship(vectors.sparkSession, books.entries)
    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def encode(batches):
        import pyarrow as pa

        entries = sent()
        digits = max(2, len(f"{entries.shape[1] - 1:x}"))
        for batch in pieces(batches, rows=ROWS):
            x, kept = integer_vectors(batch.column("embedding"))
            if not len(kept):
                continue
            found = [nearest(_part(x, p, entries), entries[p]) for p in range(len(entries))]
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in np.stack([i for i, _ in found], 1).tolist()]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(codes), pa.array(sum(d for _, d in found))], schema.names
            )

    return vectors.select("vec_id", "label", "embedding").mapInArrow(encode, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of errors over equal labels, nulls together.

    Sums are joined back to rows: broadcast if there are few labels; else those of
    the hot labels, of which there can't be many, and the others by a shuffle, in
    which no label has more than one of HOT rows.
    """
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "code-labels")
    many, total = sums.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    named = sums.select(F.col("label").alias("of"), "label_error", "rows")
    joined = lambda rows, side: rows.join(side.select("of", "label_error"), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    if many <= MOST_BROADCAST:
        return joined(coded, F.broadcast(named))
    hot = F.broadcast(named.where(F.col("rows") * HOT >= total))
    cold = coded.join(hot.select("of"), F.col("label").eqNullSafe(F.col("of")), "left_anti")
    return joined(coded, hot).unionByName(joined(cold, named))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Fit codebooks on all usable rows and code every one: vec_id, code, error, label_error, codebooks_sha256."""
    books = fit_codebooks(vectors, parts, entries, rounds)
    if books is None:
        # no row has an id; without a first codebook none can be coded
        kind = T.StructType([vectors.schema["vec_id"], *[T.StructField(c, k) for c, k in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]])
        return vectors.sparkSession.createDataFrame([], kind)
    coded = materialise(encode_vectors(vectors, books), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
