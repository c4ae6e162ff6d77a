"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned by id, encoded in the tasks that write them and
stored in ascending id order. ORC encodes the id arrays by its integer
run-length encoding, keeps row indexes and a Bloom filter of doc_id, and can be
split by stripes, so a read of some documents skips stripes and row groups by
metadata alone.

Defined results: a null text is empty, and an empty text has only the end id;
null ids come first; rows with equal ids are ordered by their texts' hashes, and
rows with equal texts as well are interchangeable; a very long text is encoded
whole and is one row; an empty table gives files without rows; only doc_id and
text are read, so further columns, whatever their names, change nothing.

Texts are encoded by their pieces where the tokenizer's own normaliser and
pre-tokenizer make that exact; with any other tokenizer whole texts are encoded.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenframe.llm.common import materialise, new_path, pieces

#: Settings of the ORC files; run-length encoding packs the ids, and further compression gains little.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.compress": "NONE",
}
#: Pieces between white space that a task remembers with their ids, and those that a worker keeps for its next task.
REMEMBERED, KEPT = 1_400_000, 1_200_000
#: What a tokenizer must do to texts for encoding by pieces to be right, and how its added tokens begin.
PIECEWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
}
ADDED = "<|"
#: Bytes of text that are encoded at a time, and new pieces that are.
SLICE, LEARNED = 1 << 20, 300


def _between(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Where bytes lie in a range; for unsigned bytes one subtraction and one comparison."""
    return (data - np.uint8(low)) <= np.uint8(high - low)


def _parted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' bytes with case folded, and the places before which a token begins within a piece.

    Letters, digits and marks are parted from each other; not a letter from a
    mark before it, since the two may be a contraction.
    """
    # A combining mark may join a small letter but not its capital, so capitals before non-ASCII bytes stay.
    data = data.copy()
    data[:-1] |= (_between(data[:-1], 65, 90) & (data[1:] < 128)).astype(np.uint8) << np.uint8(5)
    letter = _between(data | np.uint8(32), 97, 122)
    digit = _between(data, 48, 57)
    mark = _between(data, 33, 126) & ~letter & ~digit
    # The last byte of U+00C0 to U+024F: letters but for two signs, and small ones of one character but for U+0130.
    first, last = data[:-1], data[1:]
    latin = _between(first, 0xC3, 0xC9) & ~((first == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    latin &= ~((first == 0xC4) & (last == 0xB0))
    tail = letter.copy()
    tail[1:] |= latin
    other = digit | mark
    cut = (tail[:-1] & other[1:]) | (digit[:-1] & (letter | mark)[1:]) | (mark[:-1] & digit[1:])
    return data, np.flatnonzero(cut) + 1


class Numbering(dict):
    """Numbers keys as they are first asked for, and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class PieceEncoder:
    """Encodes texts by their pieces between ASCII white space, each encoded once.

    Right for tokenizers that fold case, drop white space, take digits one by one
    and split between letters and marks, but for contractions; then the ids of a
    text are the ids of its pieces in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.index = Numbering()
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def keep(self, most: int) -> None:
        """Forget all but the first ``most`` pieces; what is frequent comes up early."""
        if len(self.index) > most:
            first = itertools.islice(self.index.items(), most)
            self.index = Numbering()
            self.index.update(first)
            self.known, self.used = most, int(self.starts[most - 1] + self.sizes[most - 1])

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces, many in one text; a token belongs to the piece where its characters begin."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.asarray(encoded.ids, np.int32)
        of = np.searchsorted(begins, [a for a, _ in encoded.offsets], "right") - 1
        sizes = np.bincount(of, minlength=len(pieces)) if len(ids) else np.zeros(len(pieces), np.int64)
        known = self.known
        while known + len(pieces) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[known : known + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[known : known + len(pieces)] = sizes
        self.used += len(ids)
        self.known += len(pieces)

    def _pieces(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The pieces of all texts, and how many each text has.

        Case is folded and letters, digits and marks are parted first, as the
        tokenizer would, so fewer pieces are new; not where a special token may stand.
        """
        sizes = [len(t) + 1 for t in texts]
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum(sizes)
        if not any(b"<|" in t for t in texts):
            data, cut = _parted(data)
            data = np.insert(data, cut, 32)
            ends = ends + np.searchsorted(cut, ends)
        space = _between(data, 9, 13) | (data == 32)
        begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        before = np.searchsorted(begins, ends) + (len(data) > 0 and not space[0])
        return data.tobytes().split(), np.diff(before, prepend=0)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by ``end_id``, and the number of ids of each text."""
        if len(self.index) > REMEMBERED:
            self.keep(KEPT)
        pieces, counts = self._pieces(texts)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        for a in range(0, len(self.index.new), LEARNED):
            self._learn(self.index.new[a : a + LEARNED])
        self.index.new.clear()
        last = np.cumsum(counts)
        # each text's end is one more piece, of one id
        sizes = np.insert(self.sizes[at], last, 1)
        total = np.cumsum(sizes)
        source = np.insert(self.starts[at], last, 0)
        ids = self.flat[np.repeat(source - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        ends = total[last + np.arange(len(texts))]
        ids[ends - 1] = end_id
        return ids, np.diff(ends, prepend=0)


def fits_pieces(path: str) -> bool:
    """Whether a tokenizer's file says that it treats texts as ``PieceEncoder`` expects."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    added = all(t["content"].startswith(ADDED) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in said.get("added_tokens") or [])
    return added and all(said.get(key) == value for key, value in PIECEWISE.items())


class WholeEncoder:
    """Encodes whole texts, for tokenizers of any kind; slower than by pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def keep(self, most: int) -> None:
        """Nothing is remembered."""

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by ``end_id``, and the number of ids of each text."""
        found = [e.ids for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        sizes = np.array([len(ids) + 1 for ids in found], np.int64)
        return np.array(list(itertools.chain.from_iterable([*ids, end_id] for ids in found)), np.int32), sizes


def _encoder(path: str) -> PieceEncoder | WholeEncoder:
    """The encoder of this worker process, which keeps its pieces from task to task."""
    import os
    import sys
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("_lumenframe_worker", types.ModuleType("_lumenframe_worker")).__dict__
    if path not in kept:
        kept[path] = PieceEncoder(path) if fits_pieces(path) else WholeEncoder(path)
    return kept[path]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_documents(documents: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, text_hash, n_tokens, ids) in the order of the input's partitions."""
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("text_hash", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def encode(batches):
        import pyarrow as pa

        encoder = _encoder(tokenizer_path)
        for batch in pieces(batches, tidy=False):
            texts = [x.encode() if x else b"" for x in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                ids, sizes = encoder.encode(texts[a:b], end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("text_hash").slice(a, b - a),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                    ],
                    ["doc_id", "text_hash", "n_tokens", "ids"],
                )
        encoder.keep(KEPT)

    return documents.select("doc_id", "text_hash", "text").mapInArrow(encode, schema)


def write_tokens(documents: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write the token ids of ``documents`` as ORC in ascending doc_id order.

    Texts are shuffled once, by ranges of (doc_id, hash of text), so rows that
    share one id can spread over tasks; file names follow the ranges.
    """
    dealt = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    order = ["doc_id", "text_hash"]
    ordered = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    encode_documents(ordered, tokenizer_path, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows and the number of their file; given ids are pushed down to ORC's metadata."""
    stored = spark.read.orc(path)
    if doc_ids is not None:
        stored = stored.where(F.col("doc_id").isin(list(doc_ids)))
    number = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int")
    return stored.select("doc_id", "text_hash", "n_tokens", "ids", number.alias("file"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: each document's start among all ids, number of ids and their crc32."""
    stored = read_tokens(spark, path)
    kind = stored.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("text_hash", T.LongType()),
            T.StructField("file", T.IntegerType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def digest(batches):
        import sys

        import pyarrow as pa

        sys.modules.pop("_lumenframe_worker", None)  # what this worker kept for encoding
        for batch in pieces(batches):
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("doc_id", "text_hash", "file")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "text_hash", "file", "n_tokens", "ids_crc32"],
            )

    rows = materialise(stored.select("doc_id", "text_hash", "file", "ids").mapInArrow(digest, schema), "token-digests")
    # One row a file: files come from shuffle partitions, far fewer than documents.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select(
        "file",
        (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("file").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("upto", F.sum("n_tokens").over(within))
        .join(F.broadcast(before), "file")
        .select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokenise(documents: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``documents`` as token ORC (in the shared folder by default) and digest what was written."""
    spark = documents.sparkSession
    path = path or new_path(spark, "token-orc")
    write_tokens(documents, path, tokenizer_path, end_id)
    return token_digests(spark, path)
