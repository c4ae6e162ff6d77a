"""Sharding, quality rules, mixing and token files against plain Python."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing, quality_rules, sharding, token_orc
from lumenframe.llm.queries import SHARDS, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "the cat sat on the mat and the cat sat on the mat",
    "one\ntwo three\none\n \n \none",
    "",
    None,
    "  a\tb\x0bc\x1cd e #$ été ",
    "w " * 3000 + "end",
    "the cat sat on the mat and the cat sat on the mat",
    " ".join(f"word{k}" for k in range(60)),
    "Don't STOP 12 <|endoftext|> İstanbul é",
]


def frame(spark, texts=TEXTS, sources=None):
    rows = [(k, t, "en", (sources or ["a", "b", None])[k % 3], 0, 5) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None), rows[0]], DOCS)


def test_table_is_balanced_and_moves_few_slots():
    table = sharding.fill_table(SHARDS)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    less = sharding.fill_table(SHARDS[:-1])
    stay = table != len(SHARDS) - 1
    assert (table[stay] == less[stay]).mean() > 0.9
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 10)


def test_small_table_by_hand():
    # each shard claims its first free slot in turn
    shards, size = ["x", "y", "z"], 7
    orders = []
    for s in shards:
        a, b = sharding._draw(s, "offset") % size, sharding._draw(s, "skip") % (size - 1) + 1
        orders.append([(a + t * b) % size for t in range(size)])
    want, turn = {}, 0
    while len(want) < size:
        want[next(x for x in orders[turn % 3] if x not in want)] = turn % 3
        turn += 1
    assert list(sharding.fill_table(shards, size)) == [want[k] for k in range(size)]


def test_every_row_gets_the_shard_of_its_key(spark):
    import hashlib

    docs = frame(spark).withColumn("slot", F.lit("clash"))
    got = sharding.assign_shards(docs, "doc_id", SHARDS).collect()
    table = sharding.fill_table(SHARDS)
    assert len(got) == docs.count()
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard_id, r.shard) == (slot, table[slot], SHARDS[table[slot]])
    assert sharding.assign_shards(docs.limit(0), "doc_id", SHARDS).count() == 0


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(hit),
        len(words) < 10 or 100 * len(hit) > 20 * len(words),
    )


def test_quality_counts_match_brute_force(spark):
    got = quality_rules.judge_quality(frame(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert tuple(r)[1:7] == base_rules(None if r.doc_id is None else TEXTS[r.doc_id])
        assert 0 <= r.quality <= 1 and not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(frame(spark).limit(0)).count() == 0


def plain_em(counts):
    """Expectation-maximisation over {pattern: count} in plain Python."""
    q, n = quality_rules, len(quality_rules.RULES)
    votes = {p: [p // 3**j % 3 for j in range(n)] for p in counts}
    prior, good, bad = q.PRIOR, [list(q.START_GOOD) for _ in range(n)], [list(q.START_BAD) for _ in range(n)]
    total = sum(counts.values())

    def posterior(p):
        x = np.log(prior / (1 - prior))
        for j, v in enumerate(votes[p]):
            x += np.log(good[j][v] / bad[j][v]) if v != 1 else 0
        return 1 / (1 + np.exp(-x))

    for _ in range(q.ROUNDS):
        post = {p: posterior(p) for p in counts}
        g = sum(counts[p] * post[p] for p in counts)
        b, belief = total - g, q.BELIEF
        new_good = [[(sum(counts[p] * post[p] for p in counts if votes[p][j] == v) + belief * q.START_GOOD[v]) / (g + belief) for v in range(3)] for j in range(n)]
        new_bad = [[(sum(counts[p] * (1 - post[p]) for p in counts if votes[p][j] == v) + belief * q.START_BAD[v]) / (b + belief) for v in range(3)] for j in range(n)]
        prior, good, bad = (g + belief * q.PRIOR) / (total + belief), new_good, new_bad
    return {p: posterior(p) for p in counts}


def test_pattern_fit_matches_plain_em(spark):
    rng = np.random.default_rng(1)
    counts = {int(p): int(c) for p, c in zip(rng.choice(3 ** len(quality_rules.RULES), 30, replace=False), rng.integers(1, 40, 30), strict=True)}
    votes = spark.createDataFrame([(p,) for p, c in counts.items() for _ in range(c)], "pattern int")
    got = {r.pattern: r.quality for r in quality_rules.fit_patterns(votes).collect()}
    want = plain_em(counts)
    assert got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) < 1e-9


def test_quality_keeps_clean_text_and_drops_junk(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join("".join(rng.choice(list("abcdeinorst"), 5)) for _ in range(80)) for _ in range(60)]
    junk = [" ".join("".join(rng.choice(list("abcde"), 5)) + "###" for _ in range(80)) for _ in range(6)]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(frame(spark, clean + junk)).collect()}
    assert all(got[k] for k in range(60)) and not any(got[60 + k] for k in range(6))


def test_features_of_the_votes_match_brute_force(spark):
    for r in quality_rules.text_features(frame(spark)).collect():
        text = "" if r.doc_id is None else TEXTS[r.doc_id] or ""
        words = WORD.findall(text)
        assert r.n_lines == sum(bool(WORD.search(x)) for x in text.split("\n"))
        assert (r.n_single, r.n_distinct) == (sum(len(w) == 1 for w in words), len(set(words)))
        assert r.n_adjacent == sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert (r.n_capitals, r.n_marks) == (sum("A" <= c <= "Z" for c in text), sum(c in ".,;:!?" for c in text))


def test_fitted_verdicts_are_better_than_rules_and_than_the_start(spark):
    """On the real table the fit changes verdicts, and for the better by the labels, which it never sees."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    votes = quality_rules.text_features(docs).withColumn("pattern", quality_rules.vote_pattern())
    rows = votes.join(labels.where("quality is not null"), "doc_id", "left").toPandas()
    fitted = {r.pattern: r.quality for r in quality_rules.fit_patterns(votes.select("pattern")).collect()}
    q = quality_rules
    digits = np.array([[p // 3**j % 3 for j in range(len(q.RULES))] for p in rows.pattern])
    evidence = np.log(np.array(q.START_GOOD) / np.array(q.START_BAD)) * [1, 0, 1]
    start = np.log(q.PRIOR / (1 - q.PRIOR)) + evidence[digits].sum(axis=1) >= 0
    failed = ((rows.n_words < 10) | (100 * rows.n_repeat_words > 20 * rows.n_words)).to_numpy()
    kept = {"fitted": rows.pattern.map(fitted).to_numpy() >= 0.5, "all must pass": (digits > 0).all(axis=1), "start": start}
    known = rows.quality.notna().to_numpy() & ~failed
    wrong = {k: int((v != (rows.quality == 1).to_numpy())[known].sum()) for k, v in kept.items()}
    differ = {k: int((v != kept["fitted"])[~failed].sum()) for k, v in kept.items()}
    print(wrong, differ)
    assert differ["all must pass"] > 20 and differ["start"] > 10
    assert wrong["fitted"] < min(wrong["all must pass"], wrong["start"])


def test_targets_stop_at_the_limit_and_share_the_rest():
    got = mixing.targets({"b": 100, "a": 10, None: 1000}, (3, 1, 2), Fraction(3, 2), 2)
    assert got["a"] == 20 and got["b"] == 200 and got[None] == Fraction(3, 2) * 1110 - 220
    assert mixing.targets({}, (3, 1, 2), Fraction(3, 2), 2) == {}


def test_flow_prefers_first_copies():
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 120}, 2)
    sent = Counter()
    for (p, _), x in flow.items():
        sent[p] += x
    assert sum(flow.values()) == 270
    assert sent["a",] + sent["a", "b"] + sent["b",] == 270
    # 210 words fit in first copies, 60 in second ones
    assert sum(max(0, sent[p] - c) for p, c in {("a",): 100, ("a", "b"): 100, ("b",): 10}.items()) == 60


def test_flow_costs_least_against_all_flows():
    import itertools

    capacity, quota = {("a",): 2, ("a", "b"): 1, ("b", "c"): 2, ("d",): 3}, {"a": 4, "b": 2, "c": 1, "d": 4}
    flow = mixing.route(capacity, quota, 2)
    assert flow[("d",), "d"] == 4
    edges = [(p, s) for p in capacity for s in p]

    def cost(f):
        sent, got = Counter(), Counter()
        for (p, s), x in f.items():
            sent[p] += x
            got[s] += x
        if any(sent[p] > 2 * c for p, c in capacity.items()) or any(got[s] > q for s, q in quota.items()):
            return None
        return -sum(f.values()), sum(max(0, sent[p] - c) for p, c in capacity.items())

    every = (dict(zip(edges, x, strict=True)) for x in itertools.product(*[range(min(2 * capacity[p], quota[s]) + 1) for p, s in edges]))
    assert cost(flow) == min(c for f in every if (c := cost(f)) is not None)


def test_every_pattern_goes_through_a_network(monkeypatch):
    seen, solve = [], mixing.least_cost_flow
    monkeypatch.setattr(mixing, "least_cost_flow", lambda c, q, r, room: seen.append(set(c)) or solve(c, q, r, room))
    capacity = {("a",): 5, ("b",): 7, ("c", "d"): 4, ("d", "e"): 4, ("f", "g"): 3, (None, "g"): 2, (): 9}
    quota = {"a": 8, "b": 20, "c": 2, "d": 3, "e": 4, "f": 1, "g": 4, None: 2}
    flow = mixing.route(capacity, quota, 2)
    assert sorted(map(len, seen)) == [1, 1, 2, 2] and set().union(*seen) == set(capacity) - {()}
    assert flow == solve(capacity, quota, 2)


def test_many_patterns_that_share_sources():
    rng = np.random.default_rng(5)
    capacity = {}
    while len(capacity) < 20_000:
        capacity[tuple(sorted(rng.choice(40, rng.integers(1, 5), replace=False).tolist()))] = int(rng.integers(1, 1000))
    size = Counter()
    for p, c in capacity.items():
        for s in p:
            size[s] += c
    quota = {s: n // 2 for s, n in size.items()}
    flow = mixing.route(capacity, quota, 2)
    got, sent = Counter(), Counter()
    for (p, s), x in flow.items():
        got[s] += x
        sent[p] += x
    assert got == quota and all(0 <= sent[p] <= 2 * c for p, c in capacity.items())
    # no dearer than needed: second copies only for what all first copies can't hold
    assert sum(max(0, sent[p] - c) for p, c in capacity.items()) == max(0, sum(quota.values()) - sum(capacity.values()))


def test_equal_texts_in_several_sources_overlap(spark, monkeypatch):
    rng, seen, solve = np.random.default_rng(9), [], mixing.route
    monkeypatch.setattr(mixing, "route", lambda c, q, r, room: seen.append((c, room)) or solve(c, q, r, room))
    texts = [" ".join(f"t{k}" for _ in range(int(n))) for k, n in enumerate(rng.integers(1, 60, 200))]
    rows = [(k, texts[k % 200], "en", "ab"[k % 2] if k < 200 else [None, "a"][k % 2], 0, 5) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, source=F.col("source")).collect()
    (capacity, room), = seen
    assert set(capacity) == {("a",), ("b",), (None, "a"), ("a", "b")}
    assert room[("a", "b"), "a"] == room[("a", "b"), "b"] and sum(room.values()) == sum(r.size for r in got)
    by, source = Counter(), {k: s for k, _, _, s, _, _ in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by[source[r.doc_id], r.target] += r.taken
    assert len(by) == 3 and all(abs(x - t) <= 1 for (_, t), x in by.items())


def test_copies_with_clashing_names_repeated_and_null_ids(spark):
    rows = [(k % 40 if k % 9 else None, f"word{k % 50} " * (k % 7 + 1), "ab"[k % 2], k, k, k, k) for k in range(120)] + [(1, "same text", "a", 0, 0, 0, 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int, _rows int, _copy int, copies int")
    out = mixing.take_copies(docs, source=F.col("source"))
    assert out.schema == docs.schema
    want, got = Counter(), Counter()
    for r in mixing.mix_sources(docs, source=F.col("source")).collect():
        want[r.doc_id] += r.taken
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert +got == +want and got[None] > 0
    assert mixing.take_copies(docs.limit(0), source=F.col("source")).count() == 0


def test_many_separate_sources_stay_cheap():
    n = 100_000
    flow = mixing.route({(str(k),): 10 for k in range(n)}, {str(k): 15 for k in range(n)}, 2)
    assert len(flow) == n and set(flow.values()) == {15}


def test_mix_comes_near_targets(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["x"] * int(n)) for n in rng.integers(0, 90, 400)]
    docs = frame(spark, texts, ["a", "b", None])
    got = mixing.mix_sources(docs, F.array("source")).collect()
    assert len(got) == len(texts) + 2
    by = Counter()
    want = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.source_size, r.target] += r.taken
        want[r.source_size, r.target] = r.target
    assert all(abs(by[k] - t) <= 3 for k, t in want.items())
    again = mixing.mix_sources(docs.repartition(3), F.array("source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(docs.limit(0), F.array("source")).count() == 0


def test_long_document_does_not_displace_the_small_ones(spark):
    # goals: 9,000 of a, whose first document in the order has 16,000 words, and 21,000 of b
    first = spark.range(100).orderBy(mixing.spin(F.col("id"), 7)).first().id
    rows = [(k, "x " * (16000 if k == first else 100), "en", "a", 0, 5) for k in range(101)]
    rows += [(k, "x " * 200, "en", "b", 0, 5) for k in range(101, 201)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), F.array("source"), (3, 7), Fraction(15, 23)).collect()
    by = Counter()
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert by == {(26000, 9000.0): 9000, (20000, 21000.0): 21000}


def test_rows_are_taken_until_none_fits(spark):
    rng = np.random.default_rng(4)
    rows, goals = [], {0: 5000, 1: 777, 2: 40, 3: 100_000}
    for p in goals:
        for k, size in enumerate([*rng.integers(30, 300, 80), *rng.integers(1000, 20_000, 15)]):
            rows.append((p, k, int(size), float(rng.random()), goals[p], len(rows)))
    parts = spark.createDataFrame(rows, "p int, doc_id long, size long, spin double, goal long, row long")
    chosen = mixing._within(parts.withColumn("bucket", F.floor(F.col("spin") * 3).cast("int")), ["p"], F.col("size"), "goal").persist()
    gaps = chosen.groupBy("p").agg((F.first("goal") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap"))
    more = {r.row for r in mixing._fitting(chosen, gaps, ["p"]).collect()}
    state = [(r.p, r.size, r.chosen or r.row in more) for r in chosen.collect()]
    for p, goal in goals.items():
        gap = goal - sum(s for q, s, c in state if q == p and c)
        assert gap >= 0 and all(s > gap for q, s, c in state if q == p and not c)


def test_closing_moves_stop_only_when_no_exchange_is_nearer():
    rng = np.random.default_rng(6)
    for _ in range(300):
        sizes = np.unique(rng.integers(1, 500, 12))
        taken, free = rng.integers(0, 3, (2, len(sizes)))
        gap = int(rng.integers(0, 600))
        change = mixing.closing_moves(sizes, taken, free, gap)
        now, left = taken + change, free - change
        assert (now >= 0).all() and (left >= 0).all()
        after = gap - int((change * sizes).sum())
        into, out = [0, *sizes[left > 0]], [0, *sizes[now > 0]]
        assert abs(after) <= min(abs(gap), *(abs(after - a + b) for a in into for b in out))


def test_mix_of_overlapping_sources(spark):
    docs = frame(spark, [" ".join(["x"] * 20)] * 300).withColumn(
        "in", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    )
    got = mixing.mix_sources(docs, F.col("in")).agg(F.sum("taken"), F.sum("size")).first()
    assert abs(got[0] - 1.5 * 8000) < 600  # sources overlap, so sizes count twice in shares and are bounded by copies


def test_pieces_equal_whole_texts_for_random_characters():
    import random

    encoder, rng = token_orc.PieceEncoder(tokenizer_path()), random.Random(5)
    alphabet = "×÷éÀçėźĳƻǀɏɐaAbBsStTdDlLmMvVeErR\'\'\'\"-_.,;:!?#$%&*()[]{}|<>/\\@^`~+= 0123456789\n\té\u0301\u0308ßÑİΣς１\u2028\u00a0\x1c\x85漢字🙂²½ⅧＡ"
    for k in range(3000):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 8 if k % 2 else 60))) for _ in range(3)]
        ids, sizes = encoder.encode([t.encode() for t in texts], 2)
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert list(ids) == [i for w in want for i in w], texts
        assert list(sizes) == [len(w) for w in want]
        if k % 500 == 499:
            encoder.keep(300)


def test_token_files_equal_whole_text_encoding(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = frame(spark).where("doc_id is not null").repartition(3)
    path = f"file://{tmp_path}/tokens"
    got = sorted(map(tuple, token_orc.tokenise(docs, tokenizer_path(), 2, path).collect()))
    start, want = 0, []
    for k, t in sorted([*enumerate(TEXTS), (0, TEXTS[0])], key=lambda x: x[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = token_orc.read_tokens(spark, path, [5])
    assert [r.doc_id for r in some.collect()] == [5]
    assert "In(doc_id" in some._jdf.queryExecution().toString() or "EqualTo(doc_id,5)" in some._jdf.queryExecution().toString()


def test_token_files_of_an_empty_table_and_null_id(spark, tmp_path):
    docs = frame(spark)
    assert token_orc.tokenise(docs.limit(0), tokenizer_path(), 2).count() == 0
    first = token_orc.tokenise(docs, tokenizer_path(), 2).orderBy("start").first()
    assert first.doc_id is None and first.n_tokens == 1


def test_tokens_of_another_kind_of_tokenizer(spark):
    """A byte-level tokenizer keeps case and white space, so whole texts are encoded."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_orc.fits_pieces(tokenizer_path()) and not token_orc.fits_pieces(path)
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_orc.tokenise(frame(spark), path, 2).collect()}
    for k, t in enumerate(TEXTS):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))
