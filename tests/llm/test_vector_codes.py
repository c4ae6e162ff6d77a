"""Product quantisation against plain integers."""

import hashlib
import math

import numpy as np
import pytest

from lumenframe.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts, entries, rounds):
    kept = [
        (k, [math.floor(1024 * float(np.float32(x))) for x in v], lab)
        for k, v, lab, _ in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted((k, v) for k, v, _ in kept if k is not None)[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i], strict=True)] if i in mine else old for i, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, errors = [], {}
    for k, v, lab in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[lab] = errors.get(lab, 0) + error
        out.append((k, "".join(f"{i:02x}" for _, i in found), error, lab))
    return sorted(((k, c, e, errors[lab], digest) for k, c, e, lab in out), key=str)


def vectors(seed, many=60, width=8):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in rng.normal(size=width)], int(rng.integers(3)), "x") for k in rng.permutation(many)]
    rows += [(1000, rows[0][1], None, "x"), (1001, rows[0][1], None, "x"), (rows[1][0], rows[2][1], 1, "x"), (None, rows[3][1], 2, "x")]
    for odd in (None, [], [float("nan"), *rows[0][1][1:]], [None, *rows[0][1][1:]], [float("-inf"), *rows[0][1][1:]]):
        rows.append((-1, odd, 1, "x"))
    # ties: points midway between entries
    rows += [(2000 + k, [x / 1024 for x in (k, k, -k, 0, 2, 2, 2, 2)], 0, "x") for k in range(6)]
    return rows


@pytest.mark.parametrize(("seed", "parts", "entries"), [(1, 4, 8), (2, 2, 16), (3, 4, 256)])
def test_equals_plain_integers(spark, seed, parts, entries):
    rows = vectors(seed)
    got = codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), parts, entries, 4).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, parts, entries, 4)


def test_labels_by_shuffle(spark, monkeypatch):
    rows = vectors(5)
    monkeypatch.setattr(codes, "MOST_BROADCAST", 1)
    monkeypatch.setattr(codes, "HOT", 4)
    got = codes.vector_codes(spark.createDataFrame(rows, SCHEMA), 4, 8, 1).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 8, 1)


def test_screening_keeps_the_nearest_where_float32_cannot_tell():
    rng = np.random.default_rng(9)
    for size in (1 << 10, 1 << 18, 1 << 25):
        x = rng.integers(-size, size, (300, 16))
        entries = x[rng.integers(0, 300, 64)] + rng.integers(-1, 2, (64, 16))
        entries[40] = entries[3]
        index, distance = codes.nearest(x, entries)
        apart = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert np.array_equal(distance, apart.min(1)) and np.array_equal(index, apart.argmin(1))


def test_screening_leaves_few_entries():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(2000, 16)) * 1024).astype(np.int64)
    row, _ = codes._screen(x, x[:256])
    assert len(row) < 1.02 * len(x)


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.vector_codes(none).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1, "x"), (None, [1.0] * 8, 1, "x")], SCHEMA)).count() == 0
    for bad in ([(1, [1.0] * 8, 1, "x"), (2, [1.0] * 4, 1, "x")], [(1, [1.0] * 6, 1, "x")], [(1, [1e9] * 8, 1, "x")]):
        with pytest.raises(Exception, match="lengths|parts|component"):
            codes.vector_codes(spark.createDataFrame(bad, SCHEMA)).collect()
