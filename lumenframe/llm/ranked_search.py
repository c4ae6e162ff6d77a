"""Ranked search of whole texts by block-max bounds over blocks of variable length.

Documents become shards of a term index: one row holds the documents of a shard
in the order of their ids and the postings of the terms that queries use. Counts
over all shards give every term's weight. Searching a shard cuts each posting list
into blocks of variable length by dynamic programming, which minimises what the
blocks' largest contributions exceed the postings' own by, plus a price for each
block. The blocks in force at a document bound its score, the pivot test of
block-max WAND made for all documents of a shard at once: a block of a dense list
bounds every document from its first to its last, one of a sparse list those that
hold the term. Documents whose bound is below the least score that still counts are
skipped, and the others are scored exactly, highest bounds first, while that least
score rises. A task keeps it from shard to shard; the tasks' best rows are ranked
together.

Scores are 64-bit integers, so no order of summation changes them. Terms are
compared by 64-bit hashes. Queries are worked in groups of about GROUP_BYTES of
text, a pass over the documents each; a single query is always worked whole.

Defined results: null, empty and term-free texts are neither counted nor found; a
query without terms gives no rows; very long texts are taken whole and have a
posting for each different query term; equal scores go by ascending doc_id, null
ids last; rows that repeat an id are documents of their own, and rows that repeat
an item are ranked apart; without documents there are no rows; only doc_id and
text, and item_id and text, are read, so further columns, whatever their names,
change nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenframe.llm.common import materialise, pieces, ship
from lumenframe.llm.textscan import WordScanner, text_buffers

#: Bytes of query text that are worked together.
GROUP_BYTES = 4 << 20
#: A shard is closed at so many documents or postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 16_384, 1 << 19
#: Postings in which the blocks are chosen at once, and a block's price in average contributions of its list.
STRETCH, BLOCK_PRICE = 128, 4
#: A list is sparse in a shard if fewer than one of so many documents hold its term.
SPARSE = 16
#: Fixed values of the score: the scale of weights, of quotients and of saturation, and the shares of the length rule.
WEIGHT, QUOTIENT, PER_TERM, PER_LENGTH, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 12, 75, 25


@dataclass
class Queries:
    """A group of queries: their ids, and for each its terms as numbers in ``terms``, with repeats."""

    ids: list
    terms: np.ndarray
    number: np.ndarray
    repeats: np.ndarray
    ends: np.ndarray


def _term_lists(items: DataFrame) -> DataFrame:
    """Rows (item_id, terms, repeats) of the items with terms, hashes as bytes."""
    scanner = WordScanner("alnum")
    schema = T.StructType([items.schema["item_id"], T.StructField("terms", T.BinaryType()), T.StructField("repeats", T.BinaryType())])

    def read(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            words, _, first = scanner.scan(*text_buffers(batch.column("text")))
            found = [np.unique(words[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = [i for i, (t, _) in enumerate(found) if len(t)]
            columns = [pa.array([found[i][k].astype(kind).tobytes() for i in kept], pa.binary()) for k, kind in ((0, np.uint64), (1, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(kept, pa.int64())), *columns], schema.names)

    return items.select("item_id", "text").mapInArrow(read, schema)


def _queries(rows: list) -> Queries:
    lists = [np.frombuffer(r.terms, np.uint64) for r in rows]
    terms, number = np.unique(np.concatenate(lists), return_inverse=True)
    repeats = np.concatenate([np.frombuffer(r.repeats, np.int64) for r in rows])
    return Queries([r.item_id for r in rows], terms, number.astype(np.int64), repeats, np.cumsum([len(x) for x in lists]))


class _Shard:
    """Documents and postings that a task gathers for one row of the index."""

    def __init__(self):
        self.ids, self.sizes, self.postings = [], [], []
        self.held = self.with_terms = self.all_terms = 0

    def row(self) -> dict:
        # documents in the order of their ids, null ids last; postings by term, then document
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        many = np.array([len(t) for t, _ in self.postings], np.int64)
        none = [np.zeros(0, np.int64)]
        term = np.concatenate(none + [t for t, _ in self.postings])
        often = np.concatenate(none + [c for _, c in self.postings])
        document = np.repeat(place, many) if len(order) else none[0]
        by = np.lexsort((document, term))
        terms, df = np.unique(term, return_counts=True)
        return {
            "ids": [self.ids[i] for i in order],
            "sizes": np.array(self.sizes, np.int64)[order] if order else none[0],
            "terms": terms,
            "df": df,
            "document": document[by],
            "tf": often[by],
            "with_terms": self.with_terms,
            "all_terms": self.all_terms,
        }


def _index(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Shards: ids and numbers of terms of documents that hold query terms, postings, and counts of all documents."""
    kind = documents.schema["doc_id"].dataType
    lists = ("sizes", "terms", "df", "document", "tf")
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(kind))]
        + [T.StructField(c, T.ArrayType(T.LongType(), False)) for c in lists]
        + [T.StructField(c, T.LongType()) for c in ("with_terms", "all_terms")]
    )
    scanner, sent = WordScanner("alnum"), ship(documents.sparkSession, vocabulary)

    def index(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        terms, shard = sent(), _Shard()
        form = to_arrow_schema(schema)

        def closed():
            return pa.RecordBatch.from_pylist([shard.row()], form)

        for batch in pieces(batches):
            words, _, first = scanner.scan(*text_buffers(batch.column("text")))
            at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
            known = np.flatnonzero(terms[at] == words)
            document = np.searchsorted(first, known, "right") - 1
            # a document's postings: its distinct query terms with their numbers
            pair, often = np.unique(document * len(terms) + at[known], return_counts=True)
            cut = np.searchsorted(pair, np.arange(len(first)) * len(terms))
            sizes = np.diff(first)
            for i, id_ in enumerate(batch.column("doc_id").to_pylist()):
                shard.with_terms += int(sizes[i] > 0)
                shard.all_terms += int(sizes[i])
                a, b = cut[i], cut[i + 1]
                if a < b:
                    shard.ids.append(id_)
                    shard.sizes.append(int(sizes[i]))
                    shard.postings.append((pair[a:b] % len(terms), often[a:b]))
                    shard.held += b - a
                    if len(shard.ids) >= SHARD_DOCUMENTS or shard.held >= SHARD_POSTINGS:
                        yield closed()
                        shard = _Shard()
        if shard.with_terms:
            yield closed()

    return documents.select("doc_id", "text").mapInArrow(index, schema)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Integer weights of terms by the number of documents that hold them."""
    return np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def contributions(tf: np.ndarray, size: np.ndarray, weight: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What one occurrence of a term in a query adds to a document's score."""
    length = FLAT + SLOPE * size * documents // all_terms
    return weight * (QUOTIENT * tf // (PER_TERM * tf + PER_LENGTH * length))


def choose_blocks(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where blocks begin in posting lists that begin at ``begins``.

    In stretches of at most STRETCH postings the choice is optimal: it minimises the
    sum over blocks of length times largest value, plus a price for each block.
    """
    many = np.diff(begins, append=len(values))
    if not len(values):
        return begins
    price = BLOCK_PRICE * np.add.reduceat(values, begins) // many + 1
    stretches = -(-many // STRETCH)
    of = np.repeat(np.arange(len(begins)), stretches)
    start = begins[of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
    length = np.minimum(STRETCH, begins[of] + many[of] - start)
    order = np.argsort(-length, kind="stable")  # so the stretches that go on are always the first ones
    start, length, price = start[order], length[order], price[of[order]]
    grid = values[np.minimum(start[:, None] + np.arange(length[0]), len(values) - 1)]
    cost = np.zeros((len(start), length[0] + 1), np.int64)
    back = np.zeros((len(start), length[0] + 1), np.int16)
    largest = np.zeros_like(grid)
    for i in range(1, length[0] + 1):
        on = int(np.searchsorted(-length, -i, "right"))
        np.maximum(largest[:on, :i], grid[:on, i - 1 : i], out=largest[:on, :i])
        tried = cost[:on, :i] + largest[:on, :i] * np.arange(i, 0, -1)
        back[:on, i] = at = tried.argmin(1)
        cost[:on, i] = tried[np.arange(on), at] + price[:on]
    found, at, rows = [], length.astype(np.int64), np.arange(len(start))
    while len(rows):
        at = back[rows, at].astype(np.int64)
        found.append(start[rows] + at)
        rows, at = rows[at > 0], at[at > 0]
    return np.sort(np.concatenate(found))


def _ranges(begins: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after another."""
    return np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


class ShardIndex:
    """A shard made ready for searching: contributions, blocks, and postings by document."""

    def __init__(self, row: dict, weight: np.ndarray, documents: int, all_terms: int):
        self.many = len(row["sizes"])
        self.terms, df = row["terms"], row["df"]
        ends = np.cumsum(df)
        at = row["document"]
        value = contributions(row["tf"], row["sizes"][at], np.repeat(weight[self.terms], df), documents, all_terms)
        begins = choose_blocks(value, ends - df)
        self.block_largest = np.maximum.reduceat(value, begins) if len(begins) else value
        self.block_first, self.block_last = at[begins], at[np.append(begins[1:], len(at))[: len(begins)] - 1]
        self.block_begin = np.searchsorted(begins, ends - df)
        self.block_many = np.diff(self.block_begin, append=len(begins))
        # postings of sparse lists with what bounds them; of dense ones blocks alone are looked at
        self.sparse, self.df, self.list_begin, self.document = df * SPARSE < self.many, df, ends - df, at
        self.largest = np.repeat(self.block_largest, np.diff(begins, append=len(at)))
        by = np.argsort(at, kind="stable")
        self.term, self.value = np.repeat(self.terms, df)[by], value[by]
        self.posting_many = np.bincount(at, minlength=self.many)
        self.posting_begin = np.cumsum(self.posting_many) - self.posting_many
        self.scored = 0

    def bounds(self, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """For every document the sum of the largest contributions of the blocks that bound it."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        at, repeats = at[here], repeats[here]
        dense, often = at[~self.sparse[at]], repeats[~self.sparse[at]]
        block = _ranges(self.block_begin[dense], self.block_many[dense])
        worth = self.block_largest[block] * np.repeat(often, self.block_many[dense])
        change = np.zeros(self.many + 1, np.int64)
        np.add.at(change, self.block_first[block], worth)
        np.subtract.at(change, self.block_last[block] + 1, worth)
        bound = np.cumsum(change[:-1])
        rare, often = at[self.sparse[at]], repeats[self.sparse[at]]
        posting = _ranges(self.list_begin[rare], self.df[rare])
        np.add.at(bound, self.document[posting], self.largest[posting] * np.repeat(often, self.df[rare]))
        return bound

    def scores(self, documents: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores; ``query`` has the repeats of every term of the vocabulary."""
        many = self.posting_many[documents]
        at = _ranges(self.posting_begin[documents], many)
        self.scored += len(documents)
        return np.add.reduceat(self.value[at] * query[self.term[at]], np.cumsum(many) - many)

    def search(self, terms: np.ndarray, repeats: np.ndarray, query: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` best documents with a score above 0 and of at least ``least``; equal scores by position."""
        bound = self.bounds(terms, repeats)
        open_ = np.flatnonzero(bound >= max(1, least))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, step = 0, 4 * most
        while a < len(open_) and bound[open_[a]] >= max(1, least):
            some = open_[a : a + step]
            best, score = np.append(best, some), np.append(score, self.scores(some, query))
            order = np.lexsort((best, -score))[:most]
            best, score = best[order], score[order]
            if len(score) == most:
                least = max(least, int(score[-1]))
            a, step = a + step, 2 * step
        return best[score > 0], score[score > 0]


def _searched(index: DataFrame, queries: Queries, weight: np.ndarray, documents: int, all_terms: int, most: int, item: T.StructField) -> DataFrame:
    """Rows (item, item_id, doc_id, score): every task's best documents of each query."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), item, T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    sent = ship(index.sparkSession, (queries, weight))

    def search(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        asked, weighed = sent()
        begins = np.concatenate([[0], asked.ends])
        best: list[list[tuple]] = [[] for _ in asked.ids]
        for batch in pieces(batches, rows=1):
            names = ("sizes", "terms", "df", "document", "tf")
            row = {c: np.asarray(batch.column(c).flatten()) for c in names}
            if not len(row["tf"]):
                continue
            shard, ids = ShardIndex(row, weighed, documents, all_terms), batch.column("ids").flatten()
            query = np.zeros(len(asked.terms), np.int64)
            for k in range(len(asked.ids)):
                terms, repeats = (x[begins[k] : begins[k + 1]] for x in (asked.number, asked.repeats))
                query[terms] = repeats
                least = -best[k][-1][0] if len(best[k]) == most else 0
                found, scores = shard.search(terms, repeats, query, most, least)
                query[terms] = 0
                if len(found):
                    named = ids.take(pa.array(found)).to_pylist()
                    more = [(-s, i is None, i if i is not None else 0) for s, i in zip(scores.tolist(), named, strict=True)]
                    best[k] = sorted(best[k] + more)[:most]
        form = to_arrow_schema(schema)
        for k, rows in enumerate(best):
            if rows:
                yield pa.RecordBatch.from_pylist(
                    [{"item": k, item.name: asked.ids[k], "doc_id": None if null else i, "score": -s} for s, null, i in rows], form
                )

    return index.select("ids", "sizes", "terms", "df", "document", "tf").mapInArrow(search, schema)


def rank_documents(documents: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """Each item's ``most`` best documents: item_id, rank (from 1), doc_id, score."""
    kinds = [items.schema["item_id"], T.StructField("rank", T.IntegerType()), documents.schema["doc_id"], T.StructField("score", T.LongType())]
    result = None
    asked = items.where(F.col("text").isNotNull()).select("item_id", "text")
    groups = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES)
    for g in range(groups):
        # at most about GROUP_BYTES of hashes reach the driver, and travel to the tasks
        rows = _term_lists(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)).collect()
        if not rows:
            continue
        queries = _queries(rows)
        index = materialise(_index(documents, queries.terms), "search-index")
        with_terms, all_terms = index.agg(F.sum("with_terms"), F.sum("all_terms")).first()
        if not with_terms:
            continue
        counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
        df = np.zeros(len(queries.terms), np.int64)
        for r in counted.collect():  # a row for each term of the group
            df[r.terms] = r.df
        found = _searched(index, queries, weights(df, with_terms), with_terms, all_terms, most, items.schema["item_id"])
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = materialise(found, "search-found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.unionAll(ranked)
    return documents.sparkSession.createDataFrame([], T.StructType(kinds)) if result is None else result
