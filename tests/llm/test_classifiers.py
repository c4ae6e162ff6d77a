"""Toxicity, quality and language models: held-out accuracy on made-up texts, and edge cases."""

import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import langid, quality_zstd, toxicity
from lumenframe.llm.common import fold

EDGES = [(9001, ""), (9002, None), (9003, "1 2 !"), (9004, "word " * 60_000), (9001, ""), (None, "a text")]


def words(rng, n, letters="abdeilmnorstu"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with labels: toxic ones hold invented insults, bad ones symbols, in two alphabets."""
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(600):
        french = k % 3 == 0
        w = words(rng, rng.randrange(20, 200), "eéèêauoilnt" if french else "abdeilmnorstu")
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zorg" + rng.choice(["ble", "nak", "ti"]) if french else rng.choice(["kvetch", "blarg"]))
        if bad:
            w = [x + rng.choice(["###", "$$$", "&&&"]) for x in w]
        docs.append((k, " ".join(w), "fr" if french else "en", "s", k % 7, -1.0))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(k, t, None, None, None, None) for k, t in EDGES]
    labels += [(9001, 1, 0), (9002, None, None), (12345, 1, 1), (0, 1, None)]
    schema = "doc_id long, text string, lang string, source string, label int, score double"
    return spark.createDataFrame(docs, schema).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, modulus, held_out, least):
    rows = (
        scored.join(labels.where(F.col(label).isNotNull()), "doc_id")
        .where(fold(F.col("doc_id"), modulus) == held_out)
        .select(((F.col("score") >= least).cast("int") == F.col(label)).cast("int").alias("right"))
    )
    return rows.agg(F.avg("right")).first()[0]


def test_fold_is_crc32_of_the_id_as_text(spark):
    import zlib

    got = spark.range(200).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_toxicity_generalises_and_covers_edges(corpus):
    docs, labels = corpus
    model = toxicity.toxicity_model(docs, labels, 3, 1)
    scored = toxicity.score_toxicity(docs, model)
    assert accuracy(scored, labels, "toxic", 3, 1, 0.7) > 0.95
    rows = scored.collect()
    assert len(rows) == 600 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (9001, 9002)}) == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    none = toxicity.toxicity_model(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}


def test_scores_are_sums_of_distinct_features():
    features = toxicity.Features()
    texts = ["aa bb aa cc", "", None, "bb"]
    sets = features.sets(pa.array(texts, pa.string()))
    kept = np.sort(sets[0])[::3]
    model = toxicity.ToxicityModel(kept, np.linspace(-1, 1, len(kept)), 0.2)
    got = model.scores(pa.array(texts, pa.string()), features)
    for s, x in zip(sets, got, strict=True):
        logit = 0.2 + sum(w for f, w in zip(kept, model.weights, strict=True) if f in s)
        assert abs(x - 1 / (1 + np.exp(-logit))) < 1e-12


def test_swaps_keep_everything_but_the_terms():
    assert toxicity.swap_identities("nothing here, blackboard") == []
    assert toxicity.swap_identities("Muslim men, and women") == ["jewish women, and nonbinary", "hindu nonbinary, and transgender"]


def test_every_term_meets_all_others_of_its_kind():
    for terms in toxicity.IDENTITY_TERMS.values():
        for t in terms:
            assert sorted(toxicity.swap_identities(t, None)) == sorted(set(terms) - {t})
    assert toxicity.swap_identities("nothing here", None) == []


def test_rare_mentions_reach_the_penalty(spark, monkeypatch):
    rng, seen = random.Random(8), []
    docs = [(k, " ".join(words(rng, 20, "bdkrtz") + ["muslim"] * (k % 100 == 7))) for k in range(600)]
    docs = spark.createDataFrame([*docs, (9001, "a muslim without a label")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", lambda sets, y, weight, swapped, penalty, kept: seen.append((sets, y, weight, swapped)))
    toxicity.toxicity_model(docs, labels, 3, 1, per_class=5)
    (sets, y, weight, swapped), = seen
    outside = docs.where(fold(F.col("doc_id"), 3) != 1).where("doc_id % 100 = 7").count()
    named = [i for i in {i for i, _ in swapped} if sum(k == i for k, _ in swapped) == 5]  # the others have placed terms
    assert outside and len(named) == outside and len(swapped) == 5 * outside + 2 * (len(sets) - outside)
    assert (y >= 0).sum() == 10 and (weight[y < 0] == 0).all() and (weight[y >= 0] > 0).all()


def test_placed_terms_leave_the_rest_of_the_text():
    terms = {t for kind in toxicity.IDENTITY_TERMS.values() for t in kind}
    for text in ("one", "one two three", " a  b\nc ", "été où"):
        versions = toxicity.counterfactuals(text)
        assert len(versions) == toxicity.PLACED and versions == toxicity.counterfactuals(text)
        for v in versions:
            added = [w for w in v.split() if w not in text.split()]
            assert len(added) == 1 and added[0] in terms and [w for w in v.split() if w in text.split()] == text.split()
    assert toxicity.counterfactuals("") == toxicity.counterfactuals(" \n") == []


def test_penalty_acts_on_the_real_table(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    pairs, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: pairs.append(len(a[3])) or train(*a, **k))
    plain, fair = (toxicity.toxicity_model(docs, labels, penalty=x) for x in (0.0, toxicity.PENALTY))
    print("counterfactual pairs:", pairs)
    assert min(pairs) > 100 and (plain.features == fair.features).all()
    assert np.abs(plain.weights - fair.weights).max() > 0.01
    # a term that begins like an insult moves the penalised score less
    features, terms = toxicity.Features(), sorted({t for kind in toxicity.IDENTITY_TERMS.values() for t in kind})
    sets = [s[np.isin(s, fair.features)] for s in features.sets(pa.array(terms))]
    moved = [max(abs(m.weights[np.searchsorted(m.features, s)].sum()) for s in sets) for m in (plain, fair)]
    assert moved[1] < moved[0]


def test_features_picked_by_spark_are_those_of_numpy(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(words(rng, 15, "bdrt") + ["zorg"] * (k % 3 == 0) + ["fine"] * (k % 2))) for k in range(200)]
    sample = spark.createDataFrame([(k, t, int(k % 3 == 0)) for k, t in docs], "doc_id long, text string, label int")
    counts = toxicity._feature_counts(sample.repartition(3), toxicity.Features())
    got = toxicity._strongest(counts, {0: 133, 1: 67})
    sets = toxicity.Features().sets(pa.array([t for _, t in docs]))
    assert len(got) and (got == toxicity.strongest(sets, np.array([k % 3 == 0 for k, _ in docs], float))).all()


def test_counterfactuals_lower_scores_of_neutral_mentions():
    rng = random.Random(1)
    features = toxicity.Features()
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        w = words(rng, 30)
        # the sample is biased: one group is named mostly in toxic texts
        w.insert(3, ("muslim" if rng.random() < 0.8 else "christian") if toxic else rng.choice(["christian", "hindu", "jewish"]))
        if toxic and k % 8:
            w.insert(9, "blarg")
        text = " ".join(w)
        for version, t in enumerate([text, *toxicity.swap_identities(text)]):
            rows.append((k, int(toxic), version, features.sets(pa.array([t]))[0]))
    neutral = pa.array([" ".join([*words(rng, 10), "muslim", *words(rng, 10)]) for _ in range(50)])
    insult = pa.array([" ".join([*words(rng, 10), "blarg", *words(rng, 10)]) for _ in range(50)])
    plain = toxicity.fit_toxicity(rows, {0: 300, 1: 100}, penalty=0.0)
    fair = toxicity.fit_toxicity(rows, {0: 300, 1: 100}, penalty=1.0)
    assert fair.scores(neutral, features).mean() < 0.6 * plain.scores(neutral, features).mean()
    assert fair.scores(insult, features).mean() > 0.7


def test_quality_generalises_and_covers_edges(corpus):
    docs, labels = corpus
    model = quality_zstd.quality_model(docs, labels, 5, 0)
    scored = quality_zstd.score_quality(docs, model)
    assert accuracy(scored, labels, "quality", 5, 0, 0.3) > 0.97
    rows = scored.collect()
    assert len(rows) == 600 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    kept = quality_zstd.keep_good(docs, model, 0.3)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.score >= 0.3 for r in rows)
    assert quality_zstd.score_quality(docs.limit(0), model).count() == 0
    none = quality_zstd.quality_model(docs, labels.limit(0))
    assert {r.score for r in quality_zstd.score_quality(docs, none).collect()} == {0.5}


def test_measures_are_those_of_plain_compression():
    import zstandard

    rng = random.Random(2)
    good, bad = [[" ".join(words(rng, 80, x)).encode() for _ in range(60)] for x in ("abdeilmno", "#$%&xyz")]
    model = quality_zstd.QualityModel(quality_zstd.build_dictionary(good), quality_zstd.build_dictionary(bad), (0.0,))
    texts = [b"", b"a", good[0], bad[0], b"".join(good), b"ab" * 3000]
    for text, (difference, packed) in zip(texts, model.measures(texts), strict=True):
        size = []
        for data in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            pack = zstandard.ZstdCompressor(level=quality_zstd.LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)
            size.append(sum(len(pack.compress(text[i : i + quality_zstd.BLOCK])) for i in range(0, len(text), quality_zstd.BLOCK)))
        if not text:
            assert (difference, packed) == (0, 0)
            continue
        assert difference == (size[1] - size[0]) / sum(size) and abs(packed - np.log(sum(size) / 2 / len(text))) < 1e-12
    assert model.measures([good[1]])[0, 0] > 0 > model.measures([bad[1]])[0, 0]


def test_dictionaries_of_little_text_lose_none_of_it():
    rng = random.Random(3)
    little = [" ".join(words(rng, 20)).encode() for _ in range(2)]
    assert quality_zstd.build_dictionary(little) == b"".join(little) and quality_zstd.build_dictionary([]) == b""
    more = [" ".join(words(rng, 60)).encode() for _ in range(40)]
    assert 0 < len(quality_zstd.build_dictionary(more)) < quality_zstd.DICTIONARY


def test_language_fit_reads_every_window(spark):
    rng = random.Random(6)
    docs = [(str(k), " ".join(words(rng, 150, "abc" if k % 2 else "xyz")), "ax"[k % 2]) for k in range(40)]
    table = spark.createDataFrame(docs, "doc_id string, text string, lang string")
    rows = langid._sampled_windows(table, 4, 2).collect()
    inside = [t for k, t, _ in docs if zlib.crc32(k.encode()) % 4 != 2]
    assert sorted(len(r.windows) // langid.WINDOW for r in rows) == sorted(-(-len(t) // langid.WINDOW) for t in inside)


def test_language_generalises_and_covers_edges(corpus):
    docs, _ = corpus
    network = langid.language_model(docs, 4, 2)
    got = langid.predict_language(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where(fold(F.col("doc_id"), 4) == 2)
    assert got.where("lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    rows = langid.predict_language(docs, network).collect()
    assert len(rows) == 600 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (9001, 9002, 9003)} == {"und"}
    assert langid.predict_language(docs.limit(0), network).count() == 0
    assert langid.language_model(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict_language(docs, None).collect()} == {"und"}


def test_tables_give_the_network_of_plain_convolution():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, langid.SYMBOLS, (20, langid.WINDOW))
    network = langid.train(windows, rng.integers(0, 3, 20), ["a", "b", "c"], epochs=1)
    hidden = []
    for w, f, b in zip(langid.WIDTHS, network.filters, network.biases, strict=True):
        x = network.embedding[windows]
        response = np.stack([sum(x[:, i + k] @ f[k] for k in range(w)) + b for i in range(langid.WINDOW - w + 1)], 1)
        hidden.append(np.maximum(response.max(axis=1), 0))
    logit = np.concatenate(hidden, 1) @ network.weights + network.offset
    p = np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True)
    assert np.abs(network.probabilities(windows.astype(np.uint8)) - p).max() < 1e-4


def test_every_byte_of_a_text_counts():
    rng = random.Random(5)
    long = " ".join(words(rng, 300, "ab") + words(rng, 900, "yz"))
    short = {"a": " ".join(words(rng, 400, "ab")), "z": " ".join(words(rng, 400, "yz"))}
    windows = {k: langid.cut(np.frombuffer(t.encode(), np.uint8)) for k, t in short.items()}
    network = langid.train(np.concatenate(list(windows.values())).astype(np.int64), np.repeat([0, 1], [len(w) for w in windows.values()]), ["a", "z"])
    names, scores = langid.identify(pa.array([long, "Δ", "٣"]), network)
    assert names[0] == "z" and 0.6 < scores[0] < 0.9
    assert names[1] != "und" and names[2] == "und"


def test_labels_of_the_held_out_fold_change_nothing(corpus):
    docs, labels = corpus
    for label, modulus, held_out, fit in (("toxic", 3, 1, toxicity.toxicity_model), ("quality", 5, 0, quality_zstd.quality_model)):
        inside = fold(F.col("doc_id"), modulus) == held_out
        other = labels.withColumn(label, F.when(inside, 1 - F.col(label)).otherwise(F.col(label)))
        dumps = [pickle.dumps(fit(docs, x, modulus, held_out)) for x in (labels, other, labels.where(~inside))]
        assert dumps[0] == dumps[1] == dumps[2]
    inside = fold(F.col("doc_id"), 4) == 2
    other = docs.withColumn("lang", F.when(inside, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("lang")))
    assert pickle.dumps(langid.language_model(docs, 4, 2)) == pickle.dumps(langid.language_model(other, 4, 2))


def test_samples_for_the_driver_are_bounded_in_bytes(spark):
    from lumenframe.llm.common import within_bytes

    rows = [(k, "é" * (10 + k % 7), k % 2) for k in range(400)] + [(1000, "x" * 500, 1), (1001, None, 0), (3, "again", 1)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = within_bytes(sample, "label", 1600).collect()
    for y in (0, 1):
        mine = [r for r in got if r.label == y]
        size = sum(len((r.text or "").encode()) for r in mine)
        assert 1600 - 40 < size <= 1600 + 40 and 1000 not in {r.doc_id for r in mine}
    assert sorted(within_bytes(sample, "label", 1 << 20).collect(), key=str) == sorted(sample.collect(), key=str)
    assert sorted(got, key=str) == sorted(within_bytes(sample.repartition(5), "label", 1600).collect(), key=str)
    assert within_bytes(sample.limit(0), "label", 1600).count() == 0
