"""Decontamination against window by window search in plain Python."""

import hashlib
import random
import re

from lumenframe.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=13):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        x = words(t)
        for window in [x[i : i + size] for i in range(len(x) - size + 1)] if len(x) >= size else [x] if x else []:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def case(seed):
    rng = random.Random(seed)
    pick = lambda n: [f"w{rng.randrange(6 if seed % 2 else 300)}" for _ in range(n)]
    items = [(k, " ".join(pick(rng.choice([1, 2, 5, 12, 13, 14, 30, 60]))) + rng.choice(["", "."])) for k in range(12)]
    items += [(20, None), (21, ""), (22, "?!"), (23, items[3][1] + " tail"), (24, items[4][1]), (7, items[9][1] + " more")]
    texts = [None, "", "--", "Été 12 DIX"]
    for _ in range(60):
        w = pick(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 4)):
            x = words(rng.choice(items)[1])
            a = rng.randrange(0, len(x) + 1)
            w[(at := rng.randrange(0, len(w) + 1)) : at] = x[a : a + rng.choice([5, 13, 20, 99])]
        texts.append(rng.choice([" ", "\n", ", "]).join(w).upper())
    return items, texts


def test_report_matches_window_search(spark):
    for seed in (0, 1):
        items, texts = case(seed)
        docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words string, item_id int")
        bench = spark.createDataFrame([(k, t) for k, t in items], "item_id int, text string")
        for r in decontam.contamination_report(docs, bench).collect():
            n, hit, names = brute(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names)), texts[r.doc_id]
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
        kept = decontam.clean_documents(docs, bench)
        assert kept.columns == docs.columns
        want = [k for k, t in enumerate(texts) if not (brute(t, items)[1] and 20 * brute(t, items)[1] >= brute(t, items)[0])]
        assert sorted(r.doc_id for r in kept.collect()) == want


def test_blocks_and_parts_of_items_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    items, texts = case(0)
    long = [f"z{k}" for k in range(200)]
    items.append((40, " ".join(long)))
    texts += [" ".join(long[90:140]), " ".join(long)]
    column = pa.array(texts, pa.string())
    whole = list(decontam.local_detector([(str(k), t) for k, t in items]).inspect(column))
    assert [(n, sum(b - a for a, b in spans), names) for n, spans, names in whole] == [brute(t, items) for t in texts]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontam, "PART_WORDS", 30)
    detector = decontam.benchmark_detector(spark.createDataFrame(items, "item_id int, text string"))
    assert len(detector.stored) > 5
    assert list(detector.inspect(column)) == whole
    assert len(detector.loaded) == decontam.KEPT_BLOCKS


def test_long_spans_are_cut(spark):
    item = " ".join(f"q{k}" for k in range(30))
    text = "Start, " + " ".join(f"c{k}" for k in range(2000)) + ". " + item.upper() + "! end"
    docs = spark.createDataFrame([(1, text), (1, text), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.clean_documents(docs, bench, longest=20).collect()
    assert [r.text for r in got] == [text.replace(item.upper(), "")] * 2
    assert decontam.clean_documents(docs.limit(0), bench).count() == 0
    assert decontam.clean_documents(docs, bench.limit(0)).count() == 3


def test_each_block_is_loaded_once_for_a_piece(spark, monkeypatch):
    """Every text holds windows of every block, in an order of its own."""
    import pyarrow as pa

    rng = random.Random(3)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(15))) for k in range(12)]
    texts = [" , ".join(t for _, t in rng.sample(items, 12)) for _ in range(700)]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    detector = decontam.benchmark_detector(spark.createDataFrame(items, "item_id int, text string"))
    loads, opened = [], decontam.open_store
    monkeypatch.setattr(decontam, "open_store", lambda uri: loads.append(uri) or opened(uri))
    found = list(detector.inspect(pa.array(texts)))
    assert all(len(names) == 12 for _, _, names in found)
    assert len(detector.stored) > 3 and len(loads) == len(set(loads)) <= len(detector.stored)
    assert decontam.PIECE_ROWS > 700  # which one piece holds
