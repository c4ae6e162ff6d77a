"""The queries opN_<name> over the corpus tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import (
    decontam,
    langid,
    mixing,
    ngram_join,
    piece_bpe,
    quality_rules,
    quality_zstd,
    ranked_search,
    sharding,
    token_orc,
    toxicity,
    vector_codes,
    warc,
)
from lumenframe.llm.common import fold

#: Shards of the production layout.
SHARDS = tuple(f"shard-{k:03d}" for k in range(128))
#: The tokenizer of op10 and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: The model of op11.
PIECES = "piece_bpe_32k.model"
#: The score from which op5 takes a document as good.
LEAST_QUALITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.toxicity_model(documents, table(spark, sf_dir, "labels"), 3, 1)
    return _judged(toxicity.score_toxicity(documents, model), 3, 1, 0.7)


def _judged(scored: DataFrame, modulus: int, held_out: int, least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), 3, 90, 100)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.predict_language(documents, langid.language_model(documents, 4, 2))
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign_shards(documents, "doc_id", SHARDS)


def op5_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_zstd.quality_model(documents, table(spark, sf_dir, "labels"), 5, 0)
    return _judged(quality_zstd.score_quality(documents, model), 5, 0, LEAST_QUALITY)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contamination_report(documents, benchmark)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(documents, source=F.col("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokenise(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_ngram_join,
        op3_langid,
        op4_sharding,
        op5_quality_zstd,
        op6_quality_rules,
        op7_decontamination,
        op8_warc,
        op9_mixing,
        op10_token_orc,
        op11_sentencepiece,
        op12_vector_codes,
        op13_ranked_search,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assigning parts and replacing entries, one after another; the distance is told from exact products of doubles."""
    ctes = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT row, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS x FROM v, range(4) t(p))",
        """b0 AS MATERIALIZED (SELECT p, e, x FROM p JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v WHERE vec_id IS NOT NULL
    ORDER BY vec_id, x LIMIT 256) USING (row))""",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""a{k} AS MATERIALIZED (SELECT row, p.p, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x)
    + list_inner_product(b.x, b.x))::BIGINT * 256 + b.e) AS m FROM p JOIN b{k} b ON p.p = b.p GROUP BY row, p.p)"""
        )
        if k < rounds:
            ctes.append(
                f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(floor(s / c) ORDER BY i) AS x
    FROM (SELECT p, m % 256 AS e, i, sum(x) AS s, count(*) AS c FROM (SELECT p, m, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM p JOIN a{k} USING (row, p))
    GROUP BY ALL) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""
            )
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM b{rounds})) AS codebooks_sha256
FROM v JOIN (SELECT row, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY row) USING (row)"""


#: SQL for the queries that it can express. It can express neither trained models (1, 3, 5 and the verdict of 6), nor
#: the filling of the shard table (4), nor the choice of a mix (9), nor the tokenizers (10, 11); tests compare these.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n + b.n) AS n
    FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, coalesce(least(s.doc_id, (SELECT min(b) FROM reach WHERE a = s.doc_id)), s.doc_id) AS component_id
FROM s""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths)),
found AS (SELECT doc_id, item_id, p.n, k FROM places p JOIN windows v ON p.n = v.n AND p.g = v.g),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op12_vector_codes": _codes_sql(),
    "op13_ranked_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS t FROM benchmark),
asked AS (SELECT item_id, t, count(*) AS q FROM i GROUP BY 1, 2),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
g AS (SELECT t, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY t, c.n),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * f.n * c.n) // c.l))))::BIGINT AS score
    FROM asked JOIN f USING (t) JOIN g USING (t), c GROUP BY 1, 2)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20""",
}
