"""Ranked search against the score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, rank string, score string", "item_id int, text string, doc_id string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most):
    counted = [(k, Counter(terms(t)), len(terms(t))) for k, t, *_ in docs]
    counted = [c for c in counted if c[2]]
    n_docs, all_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for k, c, n in counted:
            m = 75 + 25 * n * n_docs // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, k is None, k or 0))
        out += [(item, r, None if null else k, -s) for r, (s, null, k) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def corpus(seed, many=400):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    docs = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 20, 20, 200]))), "x", "y") for k in range(many)]
    docs += [(many + k, docs[3][1].upper(), "x", "y") for k in range(40)]
    docs += [(many + 99, None, "x", "y"), (many + 98, "", "x", "y"), (many + 97, "... --", "x", "y"), (None, docs[5][1], "x", "y"), (7, docs[9][1], "x", "y")]
    docs.append((many + 200, " ".join(word() for _ in range(30_000)), "x", "y"))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 5, 60]))), "z") for k in range(25)]
    items += [(100, docs[3][1] + " " + docs[3][1], "z"), (101, None, "z"), (102, "??", "z"), (103, "nowhere", "z")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("seed", "most"), [(1, 20), (2, 1), (3, 500)])
def test_equals_scoring_everything(spark, monkeypatch, seed, most):
    monkeypatch.setattr(search, "SHARD_DOCUMENTS", 90)
    docs, items = corpus(seed)
    found = search.rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), most)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, most)


def test_groups_of_queries(spark, monkeypatch):
    docs, items = corpus(4, 100)
    monkeypatch.setattr(search, "GROUP_BYTES", 1500)
    found = search.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 5)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus(5, 20)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("item_id = 101")), (docs.where("text = ''"), items)):
        assert search.rank_documents(d, i).count() == 0


def best_cost(values, price):
    cost = [0]
    for i in range(1, len(values) + 1):
        cost.append(min(cost[j] + (i - j) * max(values[j:i]) + price for j in range(i)))
    return cost[-1]


def test_blocks_are_optimal():
    rng = np.random.default_rng(1)
    many = np.array([1, 2, 7, 40, search.STRETCH])
    values = rng.integers(1, 1000, many.sum())
    begins = np.cumsum(many) - many
    starts = search.choose_blocks(values, begins)
    for b, n in zip(begins, many, strict=True):
        mine, price = values[b : b + n], search.BLOCK_PRICE * values[b : b + n].sum() // n + 1
        cuts = [s - b for s in starts if b <= s < b + n]
        assert cuts[0] == 0
        cost = sum((y - x) * mine[x:y].max() + price for x, y in zip(cuts, [*cuts[1:], n], strict=True))
        assert cost == best_cost(mine.tolist(), price)
    assert {0, 300} <= set(search.choose_blocks(np.repeat(5, 1000), np.array([0, 300])).tolist())


def test_bounds_hold_and_most_documents_are_skipped():
    rng = np.random.default_rng(2)
    many, terms_ = 8000, 40
    often = rng.random(terms_) * 0.4
    often[:3] = 0.002
    lists = [np.flatnonzero(rng.random(many) < p) for p in often]
    row = {
        "sizes": rng.integers(50, 300, many), "terms": np.arange(terms_), "df": np.array([len(x) for x in lists]),
        "document": np.concatenate(lists), "tf": rng.geometric(0.6, sum(map(len, lists))),
    }
    weight = search.weights(row["df"], many)
    shard = search.ShardIndex(row, weight, many, int(row["sizes"].sum()))
    ask, repeats, query = np.arange(6), np.ones(6, np.int64), np.zeros(terms_, np.int64)
    query[ask] = 1
    held = np.unique(np.concatenate(lists))
    exact = np.zeros(many, np.int64)
    exact[held] = shard.scores(held, query)
    assert (shard.bounds(ask, repeats) >= exact).all()
    shard.scored = 0
    best, score = shard.search(ask, repeats, query, 20, 0)
    want = np.lexsort((np.arange(many), -exact))[:20]
    assert best.tolist() == want.tolist() and score.tolist() == exact[want].tolist()
    assert shard.scored < many // 4
