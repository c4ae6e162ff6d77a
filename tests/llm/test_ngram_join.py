"""The n-gram join against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import ngram_join as join
from lumenframe.llm.components import connected_components, extended_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, num, den):
    sets = {k: shingles(t, n) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((k, len(sets[k]), find(k)) for k in ids)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for base in range(25):
        text = [word() for _ in range(rng.choice([2, 3, 6, 12, 13, 25, 60, 150, 400]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [word(), copy[at]]])
            rows.append(" ".join(copy))
    rows += ["", None, " \n", rows[0].upper(), rows[3], "one", "one two", "ONE two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 60, 100)])
def test_components_match_all_pairs(spark, seed, n, num, den):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    got = sorted(map(tuple, join.similar_documents(docs, n, num, den).collect()))
    assert got == brute(rows, n, num, den)


def test_null_ids_repeats_and_empty_tables(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (9, t + " h"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, join.similar_documents(docs, 3, 80, 100).collect()), key=str)
    assert got == sorted([(None, 5, None), (5, 5, 5), (5, 5, 5), (9, 6, 5), (2, 0, 2)], key=str)
    assert join.similar_documents(docs.limit(0), 3, 80, 100).count() == 0
    kept = join.one_of_each_group(docs, 3, 80, 100)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "5", "None"]


def test_a_family_in_far_apart_parts_takes_pairs_in_proportion(spark, monkeypatch):
    """5,000 near copies of one text in ten parts that share most of it but don't link: pairs stay few, components exact."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, rows = [word() for _ in range(150)], []
    for _ in range(10):
        part = [word() if rng.random() < 0.06 else w for w in base]
        for _ in range(500):
            copy = list(part)
            for at in rng.sample(range(150), rng.randrange(0, 4)):
                copy[at] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    sets = [shingles(t, 5) for t in rows]
    often = Counter(g for s in sets for g in s)
    column = {g: k for k, g in enumerate(g for g, c in often.items() if c > 1)}
    held = np.zeros((len(rows), len(column)), np.float32)
    for i, s in enumerate(sets):
        held[i, [column[g] for g in s if g in column]] = 1
    both, size = held @ held.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    root = np.arange(len(rows))
    while True:
        least = np.array([root[linked[i]].min() for i in range(len(rows))])
        if (least == root).all():
            break
        root = least
    made, write = Counter(), join.materialise

    def counting(df, name):
        out = write(df, name)
        made[name] += out.count() if name in ("join-pairs", "join-rest") else 0
        return out

    monkeypatch.setattr(join, "materialise", counting)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(map(tuple, join.similar_documents(docs, 5, 80, 100).collect()))
    assert got == [(k, int(size[k]), int(root[k])) for k in range(len(rows))]
    assert len(set(root.tolist())) > 5
    assert made["join-pairs"] < 20 * len(rows) and made["join-rest"] < 20 * len(rows), made


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_similar_sets_share_a_signature_under_any_allocation(num, den):
    rng = np.random.default_rng(num)
    threshold = join.Threshold(num, den)
    for _ in range(400):
        size = int(rng.integers(1, 120))
        x = join.mix(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        y = x[rng.permutation(size)[: max(1, size - int(rng.integers(0, 1 + size // 5)))]]
        y = np.concatenate([y, join.mix(rng.integers(0, 1 << 62, int(rng.integers(0, 1 + size // 8)), dtype=np.uint64))])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        apart = len(x) + len(y) - 2 * both
        bits = np.bitwise_count((join.parity_bitmap(x) ^ join.parity_bitmap(y)).view(np.uint64)).sum()
        assert bits <= apart
        assert join.bitmap_distance(join.wide_bitmap(x), join.wide_bitmap(y)) <= apart
        if den * both < num * (len(x) + len(y) - both):
            continue
        assert apart <= threshold.difference(len(x), len(y))
        plan = join.bands(threshold, 200)
        band = next(b for b in plan if b.low <= max(len(x), len(y)) <= b.high)
        assert den * min(len(x), len(y)) >= num * band.low or min(len(x), len(y)) >= band.low
        for light in (-1, 0, 1, 2):
            tried = join.Band(band.number, band.low, band.high, band.segments, light if band.segments > 1 else -1)
            ours, theirs = (dict(zip(*map(np.ndarray.tolist, join.signatures(v, tried)[:2]), strict=True)) for v in (x, y))
            apart = [ours[k] ^ theirs[k] for k in ours.keys() & theirs.keys()]
            assert any(all((a & ((1 << 8 * k) - 1)).bit_count() <= k for k in range(1, 9)) for a in apart)


def test_allocation_extends_where_empty_segments_would_pair_too_much():
    plan = join.bands(join.Threshold(80, 100), 60)
    band = plan[-1]
    busy = join.allocate(plan, {band.number: (10**7, 6 * 10**8, 10**6, 3 * 10**6, 10**7)})[-1]
    idle = join.allocate(plan, {band.number: (10, 600, 0, 0, 1)})[-1]
    assert busy.light >= 0 and idle.light == -1


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain, "a", "b").collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_extended_components_are_those_of_all_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = connected_components(frame(edges[:35]), "a", "b")
    got = sorted(map(tuple, extended_components(found, frame(edges[35:]), "a", "b").collect()))
    assert got == sorted(map(tuple, connected_components(frame(edges), "a", "b").collect()))
    same = extended_components(found, frame([(None, 1)]), "a", "b")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, found.collect()))


def template_pages(many, replaced, seed=5):
    """Pages of 240 words that one template made, each with some words of its own."""
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(240)]
    rows = []
    for k in range(many):
        page = list(template)
        for at in rng.sample(range(240), replaced):
            page[at] = f"own{rng.randrange(10**9)}"
        rows.append((k, " ".join(page)))
    return rows


def enumerated_pairs(spark, rows, monkeypatch):
    """How many pairs of members the last meeting looks at, and what the join gives."""
    meetings, met = [], join._met

    def counting(every, *rest):
        sizes = every.selectExpr("sig", "cast(component <> main as long) as apart").groupBy("sig").agg({"apart": "sum", "*": "count"})
        meetings.append(sizes.selectExpr("coalesce(sum(`sum(apart)` * `count(1)`), 0)").first()[0])
        return met(every, *rest)

    monkeypatch.setattr(join, "_met", counting)
    found = sorted(tuple(r) for r in join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())
    return sum(meetings), found


def test_work_on_template_pages_is_not_quadratic(spark, monkeypatch):
    """With crowds of 16, so that pages for a test make some: over two doublings at most 2.5 times the pairs for each."""
    monkeypatch.setattr(join, "CROWD", 16)
    looked_at = []
    for many in (1000, 2000, 4000):
        pairs, found = enumerated_pairs(spark, template_pages(many, 14), monkeypatch)
        assert all(k == component for k, _, component in found)
        looked_at.append(pairs)
    assert looked_at[2] <= 2.5**2 * looked_at[0], looked_at


@pytest.mark.parametrize("replaced", [3, 4, 6])
def test_crowded_groups_lose_no_link(spark, monkeypatch, replaced):
    """Pages about the threshold apart, in groups so crowded that every further segment is asked for."""
    monkeypatch.setattr(join, "CROWD", 2)
    rows = template_pages(150, replaced)
    pairs, found = enumerated_pairs(spark, rows, monkeypatch)
    assert found == brute(rows, 3, 90, 100)


def test_deletions_meet_sets_that_differ_little():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 9).astype(np.uint64)
    for b, apart in ((a, 0), (a[1:], 1), (a[2:], 2), (np.append(a[1:], np.uint64(7)), 2), (a[3:], 3)):
        for most in (1, 2):
            x, y = (dict(zip(*join.deletions(v, most), strict=True)) for v in (a, b))
            assert any(x[k] + y[k] <= most for k in set(x) & set(y)) == (apart <= most)


def test_pairs_meet_in_the_band_of_the_larger_set_only(spark, monkeypatch):
    """Texts of one band that all reach the next are grouped by their own band's signatures; links across bands are found."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    plan = join.bands(join.Threshold(80, 100), 400)
    own = next(b for b in plan if b.low >= 150)
    reach, above = join._reach(plan, join.Threshold(80, 100)), plan[own.number + 1]
    base = [word() for _ in range(own.high + 2)]
    alone = []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(len(base)), 6):
            copy[at] = word()
        alone.append(" ".join(copy))
    assert all(reach(len(shingles(t, 5))) == [own, above] for t in alone)
    grouped, write = [], join.materialise

    def noting(df, name):
        out = write(df, name)
        grouped.extend(r[0] for r in out.select("sig").collect()) if name == "join-groups" else None
        return out

    monkeypatch.setattr(join, "materialise", noting)
    docs = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    assert sorted(map(tuple, join.similar_documents(docs, 5, 80, 100).collect())) == brute(list(enumerate(alone)), 5, 80, 100)
    sets = join.Shingler(5).sets(pa.array(alone))
    light = [join.Band(own.number, own.low, own.high, own.segments, k) for k in (-1, 0, 1, 2)]
    assert grouped and set(grouped) <= {k for s in sets for b in light for k in join.signatures(s, b)[0].view(np.int64).tolist()}
    # sizes on both sides of the border
    across = [" ".join(base[: own.high + 4 - k] + [word() for _ in range(rng.randrange(0, 20))]) for k in range(12)] + alone
    docs = spark.createDataFrame(list(enumerate(across)), "doc_id long, text string")
    got = sorted(map(tuple, join.similar_documents(docs, 5, 80, 100).collect()))
    assert got == brute(list(enumerate(across)), 5, 80, 100)
    assert len({own.low <= n <= own.high for _, n, c in got if c == 0}) == 2
