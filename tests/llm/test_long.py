"""Very long texts through the operators that walk words or bytes."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import decontam, mixing, ngram_join, quality_rules, token_orc, warc
from lumenframe.llm.queries import tokenizer_path


def test_long_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 200_000)]
    near = list(words)
    for k in range(0, 200_000, 500):
        near[k] = "x" + near[k]
    item = " ".join(words[1000:1020])
    texts = {1: " ".join(words), 2: " ".join(near), 3: "a" * 3_000_000, 4: " ".join(words[:20])}
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")

    linked = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 3, 90, 100).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4}

    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    found = {r.doc_id: (r.n_words, r.n_items) for r in decontam.contamination_report(docs, bench).collect()}
    assert found[1] == (200_000, 1) and found[3] == (1, 0)

    rules = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.judge_quality(docs).collect()}
    assert rules[1] == (200_000, sum(map(len, words))) and rules[3] == (1, 3_000_000)

    taken = mixing.mix_sources(docs, source=F.col("source")).collect()
    assert sum(r.size for r in taken) == 400_021

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = np.asarray([*tokenizer.encode(texts[1], add_special_tokens=False).ids, 2], "<u4")
    row = token_orc.tokenise(docs.where("doc_id <> 3"), tokenizer_path(), 2).where("doc_id = 1").first()
    assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))

    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    stored = {r.page_id: r.payload_digest for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()}
    assert stored == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
