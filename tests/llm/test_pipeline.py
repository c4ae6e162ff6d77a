"""The pipeline's stages, each judged on its own input, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import mixing, queries
from lumenframe.llm.common import materialise
from tests.llm import test_decontam, test_ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input and output of each stage on the smallest tables."""
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), "step")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output",
    ]
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage_drops_what_op5_rejects(spark, steps):
    rejected = ids(queries.op5_quality_zstd(spark, SF).where("predicted = 0"))
    assert rejected and ids(steps[0][1]) == ids(steps[0][0]) - rejected


def test_duplicate_stage_keeps_the_least_id_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[1][0].collect()]
    want = [k for k, _, root in test_ngram_join.brute(rows, 5, 80, 100) if k == root]
    assert sorted(ids(steps[1][1])) == want and len(want) < len(rows)


def test_decontamination_stage(spark, steps):
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
    want = set()
    for r in steps[2][0].collect():
        n, hit, _ = test_decontam.brute(r.text, items)
        if not (hit and 20 * hit >= n):
            want.add(r.doc_id)
    assert set(ids(steps[2][1])) == want


def test_mixture_stage_repeats_documents(spark, steps):
    before, after = steps[3]
    want = {r.doc_id: r.copies for r in mixing.mix_sources(before, source=F.col("source")).collect() if r.copies}
    assert ids(after) == want


def test_token_stage_equals_whole_text_encoding(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    before, after = steps[4]
    start, want = 0, []
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        data = np.asarray([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_applies_all_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[4][1].collect()))
