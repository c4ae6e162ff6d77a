"""Benchmark decontamination by a generalised suffix automaton of the test items.

Documents stream through the automaton in parallel: after each word its state
gives the longest run of words, ending there, that occurs in some item. Runs of at
least ``window`` words cover hit words and name the items; an item with fewer
words is a window of its own.

Items are dealt to blocks of bounded size. Tasks build the automaton of each block
and store it in the shared folder; every task that reads documents has only the
hashes of all windows, eight bytes and a block's number for each, and a bit table
of word pairs. Stretches of a document whose neighbours are all such pairs are
looked up among the windows, and only the automata of blocks that hold one of
theirs are loaded and walked, at most KEPT_BLOCKS at a time. A task looks at
PIECE_BYTES of text at once and walks its stretches block by block, so a block is
loaded once for so many bytes at most. A task's memory grows with the benchmark by
twelve bytes a word, and the driver's likewise.

Defined results: null and empty texts have no words; texts of any length are read
whole; an item without words is ignored, and one with a null id too; items that
share an id count as one item with the windows of all; a document row that repeats
gets a row each; empty tables give no rows, or no hits; other columns do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import new_path, open_store, pieces, ship
from lumenframe.llm.textscan import WordScanner, mix, text_buffers

#: Words of the longest window.
WINDOW = 13
#: Bytes of items in one block, whose automaton takes some 60 MB in a task; automata a task keeps; words after which an item is cut.
BLOCK_BYTES, KEPT_BLOCKS, PART_WORDS = 256 << 10, 2, 20_000
#: Rows and bytes of text that are looked at together.
PIECE_ROWS, PIECE_BYTES = 20_000, 8 << 20
#: Bits of the word-pair table.
PAIR_BITS = 22
#: Bytes of benchmark text that are accepted, some 130 MB of window hashes: test sets are published by hand and small.
MOST_BENCHMARK_BYTES = 64 << 20


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of word hashes (Blumer et al., 1985)."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] = [{}]
        holders: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        for number, (_, words) in enumerate(items):
            state = 0
            for w in words:
                state = self._extend(state, w, holders)
            if 0 < len(words) < window:
                whole.setdefault(state, set()).add(number)
            state = 0
            for w in words:  # the states of the item's prefixes; their suffixes follow by links
                state = self.next[state][w]
                holders[state].add(number)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                holders[self.link[s]] |= holders[s]
        # what a match of a state shows: the items that hold the window that ends here, and shorter whole items
        self.window_items: dict[int, set[int]] = {}
        self.short_items: dict[int, list[tuple[int, set[int]]]] = {}
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            above = self.link[s]
            if self.length[s] >= window:
                inherited = self.window_items.get(above) if self.length[above] >= window else None
                self.window_items[s] = inherited or holders[s]
            short = list(self.short_items.get(above, ()))
            if s in whole:
                short.append((self.length[s], whole[s]))
            if short:
                self.short_items[s] = short

    def _extend(self, last: int, w: int, holders: list[set[int]]) -> int:
        """The state of the word sequence of ``last`` followed by ``w``."""
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q, holders)
        new = self._state(self.length[last] + 1, {}, holders)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q, holders)
        return new

    def _clone(self, p: int, w: int, q: int, holders: list[set[int]]) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), holders)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, edges: dict[int, int], holders: list[set[int]]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(edges)
        holders.append(set())
        return len(self.length) - 1

    def walk(self, words: list[int], spans: list[tuple[int, int]], found: set[int], base: int = 0) -> None:
        """Append the spans (from, to) of ``words`` that windows cover and add their items' numbers."""
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(w, 0)
            size = size + 1 if state else 0
            if not state:
                continue
            if size >= self.window:
                found |= self.window_items[state]
                spans.append((base + i + 1 - size, base + i + 1))
            if self.short_items:
                for n, numbers in self._short(state, size):
                    found |= numbers
                    spans.append((base + i + 1 - n, base + i + 1))

    def _short(self, state: int, size: int) -> Iterator[tuple[int, set[int]]]:
        return ((n, x) for n, x in self.short_items.get(state, ()) if n <= size)


@dataclass
class Block:
    """What documents are looked up by before a block's automaton is: hashes of windows and word pairs, single words, lengths of windows."""

    windows: np.ndarray
    pairs: np.ndarray
    single: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]], window: int) -> Block:
        hashes, pairs, single, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], set()
        for _, words in items:
            n = min(window, len(words))
            if n:
                lengths.add(n)
                hashes.append(next(h for k, h in window_hashes(words, n) if k == n))
                pairs.append(_pair_hashes(words))
                single += words[:1].tolist() if n == 1 else []
        return cls(np.unique(np.concatenate(hashes)), np.unique(np.concatenate(pairs)), np.array(single, np.uint64), np.array(sorted(lengths), np.int64))


def window_hashes(words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length up to ``most`` the hashes of all windows of so many words."""
    odd = mix(np.arange(1, most + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(words), np.uint64)
    for n in range(1, min(most, len(words)) + 1):
        total = total[: len(words) - n + 1] + words[n - 1 :] * odd[n - 1]
        yield n, mix(total + np.uint64(n))


@dataclass
class Detector:
    """The windows of all blocks with their blocks, and where each block's automaton is stored."""

    stored: list
    blocks: list[Block]
    window: int = WINDOW
    loaded: OrderedDict = field(default_factory=OrderedDict)

    def __post_init__(self):
        self.scanner = WordScanner("alnum")
        many = [len(b.windows) for b in self.blocks]
        windows = np.concatenate([np.zeros(0, np.uint64), *[b.windows for b in self.blocks]])
        order = np.argsort(windows, kind="stable")
        self.windows, self.holder = windows[order], np.repeat(np.arange(len(many), dtype=np.int32), many)[order]
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for b in self.blocks:
            self.pairs[b.pairs] = True
        self.single = np.unique(np.concatenate([np.zeros(0, np.uint64), *[b.single for b in self.blocks]]))
        self.lengths = sorted({int(n) for b in self.blocks for n in b.lengths})
        self.blocks = []

    def automaton(self, block: int) -> SuffixAutomaton:
        """A block's automaton, loaded if it isn't one of those used last."""
        if not isinstance(self.stored[block], str):
            return self.stored[block]
        if block not in self.loaded:
            while len(self.loaded) >= KEPT_BLOCKS:
                self.loaded.popitem(last=False)
            system, path = open_store(self.stored[block])
            with system.open_input_file(path) as file:
                self.loaded[block] = cloudpickle.loads(file.read())
        self.loaded.move_to_end(block)
        return self.loaded[block]

    def _stretches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of runs of words within a text that known pairs join and that may hold a window."""
        joined = np.zeros(len(words) + 1, bool)
        joined[1:-1] = self.pairs[_pair_hashes(words)]
        joined[first[:-1]] = False
        starts = np.flatnonzero(~joined[:-1])
        sizes = np.diff(np.append(starts, len(words)))
        long = sizes >= (self.lengths or [1])[0]
        if len(self.single):
            long &= (sizes > 1) | np.isin(words[starts], self.single)
        return starts[long], sizes[long]

    def _holders(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(block, stretch) for blocks with a window that the stretch holds."""
        before = np.concatenate([[0], np.cumsum(sizes)])
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        flat = words[np.arange(before[-1]) - before[stretch] + starts[stretch]]
        found = [np.zeros((0, 2), np.int64)]
        for n, hashes in window_hashes(flat, self.lengths[-1]):
            if n not in self.lengths:
                continue
            at = np.flatnonzero(np.arange(len(hashes)) + n <= before[stretch[: len(hashes)] + 1])
            low, high = (np.searchsorted(self.windows, hashes[at], side) for side in ("left", "right"))
            many = high - low
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            found.append(np.unique(np.column_stack([self.holder[place], np.repeat(stretch[at], many)]), axis=0))
        return list(map(tuple, np.unique(np.concatenate(found), axis=0).tolist()))

    def inspect(self, column) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, the spans of hit words, merged, and the items found."""
        words, _, first = self.scanner.scan(*text_buffers(column))
        spans: dict[int, list[tuple[int, int]]] = {}
        names: dict[int, set[str]] = {}
        starts, sizes = self._stretches(words, first)
        of = np.searchsorted(first, starts, "right") - 1
        for block, k in self._holders(words, starts, sizes) if len(starts) and self.lengths else ():
            automaton, doc, found = self.automaton(block), int(of[k]), set()
            piece = words[starts[k] : starts[k] + sizes[k]].tolist()
            automaton.walk(piece, spans.setdefault(doc, []), found, int(starts[k] - first[doc]))
            names.setdefault(doc, set()).update(automaton.names[x] for x in found)
        for doc in range(len(first) - 1):
            yield int(first[doc + 1] - first[doc]), _merged(spans.get(doc, [])), sorted(names.get(doc, ()))


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    if len(words) < 2:
        return np.zeros(0, np.int64)
    joined = mix(words[:-1]) * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    return (mix(joined) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_parts(items, scanner: WordScanner, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, words) of the items with words; long ones are cut into parts that share all but one word of a window."""
    words, _, first = scanner.scan(*text_buffers(items))
    for row, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for at in range(a, max(a + 1, b - window + 1), PART_WORDS) if b > a else ():
            yield row, words[at : min(b, at + PART_WORDS + window - 1)]


def local_detector(items: list[tuple[str, str | None]], window: int = WINDOW) -> Detector:
    """A detector of few items whose automaton isn't stored."""
    import pyarrow as pa

    parts = [(items[row][0], w) for row, w in item_parts(pa.array([t for _, t in items], pa.string()), WordScanner("alnum"), window)]
    return Detector([SuffixAutomaton([(name, w.tolist()) for name, w in parts], window)], [Block.of(parts, window)], window)


def benchmark_detector(benchmark: DataFrame, window: int = WINDOW) -> Detector:
    """The detector of a benchmark: tasks build and store the blocks' automata, the driver gets hashes of windows."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MOST_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; pass parts of at most {MOST_BENCHMARK_BYTES}")
    folder = new_path(benchmark.sparkSession, "suffix-automata")
    many = max(1, -(-size // BLOCK_BYTES))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()

    def cut(batches):
        import pyarrow as pa

        scanner = WordScanner("alnum")
        for batch in pieces(batches):
            rows = list(item_parts(batch.column("text"), scanner, window))
            ids = batch.column("item_id").take(pa.array([r for r, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([w.tobytes() for _, w in rows], pa.binary())], ["item", "words"])

    parts = items.mapInArrow(cut, "item string, words binary")
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(many)).cast("int"))

    def build(key, table):
        import pyarrow as pa

        rows = sorted(zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True))
        held = [(name, np.frombuffer(w, np.uint64)) for name, w in rows]
        automaton = SuffixAutomaton([(name, w.tolist()) for name, w in held], window)
        system, root = open_store(folder)
        system.create_dir(root, recursive=True)
        name = uuid.uuid4().hex  # of this attempt
        with system.open_output_stream(f"{root}/{name}") as file:
            file.write(cloudpickle.dumps(automaton))
        block = Block.of(held, window)
        values = [[f"{folder}/{name}"], *[[getattr(block, c).tobytes()] for c in ("windows", "pairs", "single", "lengths")]]
        return pa.table([pa.array(values[0]), *[pa.array(v, pa.binary()) for v in values[1:]]], names=["path", "windows", "pairs", "single", "lengths"])

    built = parts.groupBy("block").applyInArrow(build, "path string, windows binary, pairs binary, single binary, lengths binary").collect()
    kinds = {"windows": np.uint64, "pairs": np.int64, "single": np.uint64, "lengths": np.int64}
    blocks = [Block(**{c: np.frombuffer(r[c], kind) for c, kind in kinds.items()}) for r in built]
    return Detector([r.path for r in built], blocks, window)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, spans of hit words (from, to) and the ids of items found; no shuffle."""
    detector = ship(documents.sparkSession, benchmark_detector(benchmark, window))
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType(
        [
            documents.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def inspect(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        here = detector()
        for batch in pieces(batches, PIECE_ROWS, PIECE_BYTES):
            rows = list(here.inspect(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([sum(b - a for a, b in spans) for _, spans, _ in rows], pa.int64()),
                    pa.array([[{"from": a, "to": b} for a, b in spans] for _, spans, _ in rows], kind),
                    pa.array([names for _, _, names in rows], pa.list_(pa.string())),
                ],
                schema.names,
            )

    return documents.select("doc_id", "text").mapInArrow(inspect, schema)


def contaminated():
    """The coverage limit: hit words are at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_contamination() with the number and digest of the items and the verdict."""
    found = find_contamination(documents, benchmark)
    joined = F.concat_ws(",", F.array_sort("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the bytes from the first to the last word of each span."""
    import re

    if text is None or not spans:
        return text
    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: int | None = None) -> DataFrame:
    """The input's columns, with contaminated documents left out.

    Given ``longest``, spans of hit words longer than that are cut from the texts
    that stay; without it those texts are unchanged. Rows are judged where they
    lie: the table isn't joined to its verdicts, so rows that repeat an id do no harm.
    """
    detector = ship(documents.sparkSession, benchmark_detector(benchmark, window))

    columns = documents.columns

    def clean(batches):
        import pyarrow as pa

        at, here = columns.index("text"), detector()
        for batch in pieces(batches, PIECE_ROWS, PIECE_BYTES):
            keep, texts = [], []
            for text, (n, spans, _) in zip(batch.column(at), here.inspect(batch.column(at)), strict=True):
                hit = sum(b - a for a, b in spans)
                keep.append(not (hit and 20 * hit >= n))
                if longest is not None and keep[-1]:
                    texts.append(remove_spans(text.as_py(), [(a, b) for a, b in spans if b - a > longest]))
            mask = pa.array(keep, pa.bool_())
            kept = batch.filter(mask)
            if longest is not None:
                kept = kept.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield kept

    return documents.mapInArrow(clean, documents.schema)
