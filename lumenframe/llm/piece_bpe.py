"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The characters of many texts stand in one flat array. It is cut where no piece of
the vocabulary holds the two characters beside each other, so no merge crosses a
cut, and equal words between cuts are merged once. In a round every word looks for
its best pair by a segmented minimum of ranks, merges all leftmost occurrences of
it at once, and the arrays are compacted; words without a pair leave, until none
is left. Merging all occurrences at once equals the library's order if no pair with
the new piece ranks as well as the piece itself; pieces for which that does not
hold, or that share their score with another, are merged one a round. A word of
more than LONG characters, of which there may be no bound, goes through a heap
instead, whose work grows with the word times its logarithm.

Models must be BPE with byte fallback, without normalisation, user-defined or
unused pieces; others give an error. Defined results: a null text is empty, and an
empty text has the begin and end ids only; bytes that are no UTF-8 count as
U+FFFD; a very long text is worked in slices that end at cuts, and needs about a
dozen bytes a character; of pairs that rank alike the leftmost is merged first;
rows that repeat an id, and null ids, are rows of their own; an empty table gives
no rows; only doc_id and text are read, so further columns, whatever their names,
change nothing.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenframe.llm.common import pieces, ship

#: The white space mark, and what an unknown id decodes to.
MARK, UNKNOWN_SURFACE = 0x2581, " ⁇ "
#: Characters worked at a time, and those beyond which a word goes through the heap.
SLICE, LONG = 1 << 20, 256
#: Slots of the table of character pairs that pieces hold; a shared slot only leaves a cut out.
SLOTS = 1 << 22
_NONE = np.int64(1 << 40)


class PieceTable:
    """What encoding and decoding need of a model, as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = pb.ModelProto.SentencePiece
        spec, trainer = model.normalizer_spec, model.trainer_spec
        known = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("the model is not BPE with byte fallback and white space before words")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the model normalises texts")
        if model.denormalizer_spec.precompiled_charsmap or any(p.type not in known for p in model.pieces):
            raise ValueError("the model has user-defined or unused pieces, or changes decoded texts")
        self.bos, self.eos = trainer.bos_id, trainer.eos_id
        names = [p.piece for p in model.pieces]
        kind = np.array([p.type for p in model.pieces])
        self.byte = kind == kinds.BYTE
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.byte):
            self.byte_ids[int(names[i], 16) if names[i].startswith("0x") else int(names[i][1:-1], 16)] = i
        self.silent = kind == kinds.CONTROL
        self._numbers(names, kind == kinds.NORMAL, np.array([p.score for p in model.pieces], np.float64))
        self._surfaces(names, kind == kinds.UNKNOWN)

    def _numbers(self, names: list[str], normal: np.ndarray, scores: np.ndarray) -> None:
        """Symbols of characters, merges with their ranks, and the characters that may stand side by side."""
        ids = {names[i]: int(i) for i in np.flatnonzero(normal)}
        self.size = len(names)
        chars = sorted({c for name in ids for c in name})
        # a character that is no piece itself may still be part of one
        symbol = {c: ids.get(c, self.size + k) for k, c in enumerate(chars)}
        self.codes = np.array([ord(c) for c in chars], np.int64)
        self.symbols = np.array([symbol[c] for c in chars], np.int32)
        keys, made, side = [], [], set()
        for name, i in ids.items():
            for k in range(1, len(name)):
                left, right = name[:k], name[k:]
                a = symbol.get(left) if k == 1 else ids.get(left)
                b = symbol.get(right) if len(right) == 1 else ids.get(right)
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
            side.update(zip(name, name[1:], strict=False))
        order = np.argsort(keys, kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        best = np.full(self.size + len(chars), _NONE)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            np.minimum.at(best, part, self.rank[self.made])
        shared = np.bincount(self.rank[normal], minlength=len(names)) > 1
        self.single = (best[: self.size] <= self.rank) | shared[self.rank]
        place = {c: k for k, c in enumerate(chars)}
        self.beside = np.unique(self._slot(*(np.array([place[p[k]] for p in side], np.int64) for k in (0, 1))))

    def _surfaces(self, names: list[str], unknown: np.ndarray) -> None:
        """What each id decodes to, as one array of bytes."""
        said = []
        for i, name in enumerate(names):
            if self.byte[i]:
                said.append(bytes([int(np.flatnonzero(self.byte_ids == i)[0])]))
            elif self.silent[i]:
                said.append(b"")
            else:
                said.append((UNKNOWN_SURFACE if unknown[i] else name.replace(chr(MARK), " ")).encode())
        self.marked = np.array([not (b or s) and name.startswith(chr(MARK)) for b, s, name in zip(self.byte, self.silent, names, strict=True)])
        self.lengths = np.array([len(s) for s in said], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.surface = np.frombuffer(b"".join(said), np.uint8)

    @staticmethod
    def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 40_503 + right * 1_000_003) & (SLOTS - 1)


class PieceCodec:
    """Encodes and decodes with a table; one for each task."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.place = np.full(0x110000, -1, np.int32)
        self.place[table.codes] = np.arange(len(table.codes), dtype=np.int32)
        self.beside = np.zeros(SLOTS, bool)
        self.beside[table.beside] = True
        self.power = self.inverse = np.zeros(0, np.uint64)

    # encoding

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with those of begin and end, and the number of ids of each text."""
        parts, sizes = [], []
        a = held = 0
        for b, text in enumerate([*texts, None]):
            if b > a and (text is None or held + len(text) >= SLICE):
                ids, many = self._group(texts[a:b])
                parts.append(ids)
                sizes.append(many)
                a, held = b, 0
            held += len(text or "") + 1
        return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        # the mark stands before every text that isn't empty, and so does a space in the joined one
        codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        codes[codes == 32] = MARK
        ends = np.cumsum(lengths)
        begins = (ends - lengths)[lengths > 0]
        found, many = [np.zeros(0, np.int32)], np.zeros(len(codes) + 1, np.int32)
        for a, b, starts in self._slices(codes, begins):
            ids, sizes = self._words(codes[a:b], starts - a)
            found.append(ids)
            many[starts] = sizes
        upto = np.concatenate([[0], np.cumsum(many[:-1], dtype=np.int64)])
        counts = upto[ends] - upto[ends - lengths]
        flat, last = np.concatenate(found), np.cumsum(counts)
        around = np.stack([last - counts, last], 1).ravel()
        return np.insert(flat, around, np.tile(np.array([self.table.bos, self.table.eos], np.int32), len(texts))), counts + 2

    def _slices(self, codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Parts of the characters that end at cuts, and where words start in each."""
        a, step = 0, SLICE
        while a < len(codes):
            b = min(len(codes), a + step)
            near = self.place[codes[a : b + 1]].astype(np.int64)
            cut = np.ones(len(near), bool)
            left, right = near[:-1], near[1:]
            cut[1:] = ~((left >= 0) & (right >= 0) & self.beside[PieceTable._slot(left, right)])
            cut[begins[np.searchsorted(begins, a) : np.searchsorted(begins, a + len(near))] - a] = True
            starts = a + np.flatnonzero(cut)
            if b < len(codes):
                # the last cut ends the slice; a word that fills it asks for more
                if len(starts) < 2:
                    step *= 2
                    continue
                b, starts = int(starts[-1]), starts[:-1]
            yield a, b, starts[starts < b]
            a, step = b, SLICE

    def _words(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order and the number of each word's; equal words are merged once."""
        lengths = np.diff(starts, append=len(codes))
        first, of = self._distinct(codes, starts, lengths)
        ids, sizes = self._merged(codes, starts[first], lengths[first])
        begin = np.cumsum(sizes) - sizes
        many = sizes[of]
        at = np.repeat(begin[of] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return ids[at], many

    def _distinct(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and the kind of each word; hashes propose, characters decide."""
        self._powers(len(codes))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[: len(codes)], out=total[1:])
        hashes = (total[starts + lengths] - total[starts]) * self.inverse[starts]
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if np.array_equal(lengths[first][of], lengths):
            at = np.repeat(starts[first][of] - starts, lengths) + np.arange(len(codes))
            if np.array_equal(codes[at], codes):
                return first, of
        return np.arange(len(starts)), np.arange(len(starts))

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            grown, back = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            grown[0] = back[0] = 1
            self.power, self.inverse = np.cumprod(grown), np.cumprod(back)

    def _merged(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, and the number of each word's."""
        short = np.flatnonzero(lengths <= LONG)
        ends = np.cumsum(lengths[short])
        at = np.repeat(starts[short] - (ends - lengths[short]), lengths[short]) + np.arange(int(lengths[short].sum()))
        place = self.place[codes[at]]
        symbols = np.where(place >= 0, self.table.symbols[place], -1).astype(np.int32)
        words, out = [np.repeat(short, lengths[short])], []
        done, where = self._rounds(symbols, words[0])
        out.append(self._fallback(done, where, codes, starts, lengths))
        for w in np.flatnonzero(lengths > LONG):
            part = codes[starts[w] : starts[w] + lengths[w]]
            place = self.place[part]
            left = _by_heap(np.where(place >= 0, self.table.symbols[place], -1).tolist(), self._pair_of, self.table.rank)
            out.append(self._fallback(np.array(left, np.int32), np.full(len(left), w), codes, starts, lengths))
        ids, words = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        if len(out) > 1:
            order = np.argsort(words, kind="stable")
            ids, words = ids[order], words[order]
        return ids, np.bincount(words, minlength=len(starts))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.table.keys, key), len(self.table.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.table.keys[at] == key), self.table.made[at], -1)

    def _pair_of(self, left: int, right: int) -> int:
        if left < 0 or right < 0:
            return -1
        key = left << 32 | right
        at = int(np.searchsorted(self.table.keys, key))
        return int(self.table.made[at]) if at < len(self.table.keys) and self.table.keys[at] == key else -1

    def _rounds(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all words at once: what is left of them, and each symbol's word, in the words' order."""
        rank, single = self.table.rank, self.table.single
        done = []
        inside = words[1:] == words[:-1]
        makes = np.full(len(symbols), -1, np.int32)
        makes[:-1][inside] = self._pairs(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            begins = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            many = np.diff(begins, append=len(words))
            ranks = np.where(makes >= 0, rank[makes], _NONE)
            best = np.minimum.reduceat(ranks, begins)
            over = np.repeat(best == _NONE, many)
            if over.any():
                done.append((symbols[over], words[over]))
                symbols, words, makes, ranks = symbols[~over], words[~over], makes[~over], ranks[~over]
                many, best = many[best < _NONE], best[best < _NONE]
                begins = np.cumsum(many) - many
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(best, many))
            # of hits that overlap every second one stays; of pieces that are merged singly the word's first
            run = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            along = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
            alone = single[makes[hit]] & (np.diff(words[hit], prepend=-1) == 0)
            hit = hit[(along % 2 == 0) & ~alone]
            symbols[hit] = makes[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[hit] = True
            fresh[hit[hit > 0] - 1] = True
            # the symbol before a merged one may itself have been taken away; then the merge to its left is fresh already
            symbols, words, makes, fresh = symbols[stay], words[stay], makes[stay], fresh[stay]
            at = np.flatnonzero(fresh)
            follows = np.minimum(at + 1, len(symbols) - 1)
            within = (at + 1 < len(symbols)) & (words[follows] == words[at])
            makes[at] = np.where(within, self._pairs(symbols[at], symbols[follows]), -1)
        if not done:
            return symbols, words
        symbols, words = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def _fallback(self, symbols: np.ndarray, words: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as the ids of their bytes."""
        odd = (symbols < 0) | (symbols >= self.table.size)
        if not odd.any():
            return symbols, words
        at = np.flatnonzero(odd)
        # how many characters stand before a symbol in its word
        width = np.ones(len(symbols), np.int64)
        width[~odd] = self._width()[symbols[~odd]]
        upto = np.cumsum(width) - width
        first = np.searchsorted(words, words[at])
        char = codes[starts[words[at]] + upto[at] - upto[first]]
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in char.tolist()]
        many = np.ones(len(symbols), np.int64)
        many[at] = [len(b) for b in spelt]
        out = np.repeat(symbols, many)
        ends = np.cumsum(many)
        spans = np.repeat(ends[at] - many[at], many[at]) + _within(many[at])
        out[spans] = self.table.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return out, np.repeat(words, many)

    def _width(self) -> np.ndarray:
        """Characters of each piece; of UTF-8 bytes those that begin one, and a mark was one character too."""
        if not hasattr(self, "_widths"):
            lead = np.concatenate([[0], np.cumsum((self.table.surface & 0xC0) != 0x80)])
            self._widths = lead[self.table.starts + self.table.lengths] - lead[self.table.starts]
        return self._widths

    # decoding

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of rows of ids; bytes that make no character are U+FFFD each."""
        table = self.table
        lengths, begins = table.lengths[ids], table.starts[ids]
        ends = np.cumsum(sizes)
        # the space that encoding put before a text goes: of its first id that says anything
        heard = np.flatnonzero(~table.silent[ids])
        row = np.searchsorted(ends, heard, "right")
        first = heard[np.diff(row, prepend=-1) > 0]
        first = first[table.marked[ids[first]]]
        lengths[first] -= 1
        begins[first] += 1
        upto = np.concatenate([[0], np.cumsum(lengths)])
        data = table.surface[np.repeat(begins - upto[:-1], lengths) + np.arange(upto[-1])].tobytes()
        out = []
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            said = data[upto[a] : upto[b]]
            if table.byte[ids[a:b]].any() and not (_is_utf8(said) and not table.silent[ids[a + 1 : b - 1]].any()):
                said = self._mended(ids[a:b], [data[upto[k] : upto[k + 1]] for k in range(a, b)])
            out.append(said)
        return out

    def _mended(self, ids: np.ndarray, said: list[bytes]) -> bytes:
        """A row's text where runs of byte ids, which any other id ends, are not all characters."""
        out, run = [], b""
        for is_byte, part in [*zip(self.table.byte[ids].tolist(), said, strict=True), (False, b"")]:
            if is_byte:
                run += part
                continue
            out += [_valid(run), part]
            run = b""
        return b"".join(out)


def _within(many: np.ndarray) -> np.ndarray:
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _valid(run: bytes) -> bytes:
    """A run of bytes with U+FFFD for each byte that is part of no character."""
    out, at = [], 0
    while at < len(run):
        n = next((n for n in (1, 2, 3, 4) if _is_utf8(run[at : at + n])), 0)
        out.append(run[at : at + n] if n else "\ufffd".encode())
        at += n or 1
    return b"".join(out)


def _by_heap(symbols: list[int], pair, rank: np.ndarray) -> list[int]:
    """What merges leave of one long word: the best pair first, the leftmost of equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def made(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            piece = pair(a, b)
            known[a, b] = piece, int(rank[piece]) if piece >= 0 else -1
        return known[a, b]

    heap = []
    for i in range(n - 1):
        piece, r = made(symbols[i], symbols[i + 1])
        if piece >= 0:
            heap.append((r, i, symbols[i], symbols[i + 1], piece))
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, a, b, piece = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], gone[j], after[i] = piece, 1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                new, r = made(symbols[x], symbols[y])
                if new >= 0:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y], new))
    return [s for s, out in zip(symbols, gone, strict=True) if not out]


def _texts(column) -> list[str]:
    import pyarrow as pa

    kind = pa.binary() if pa.types.is_string(column.type) else pa.large_binary()
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(kind).to_pylist()]


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, ids) in the order of the input's partitions, with begin and end ids."""
    table = ship(documents.sparkSession, PieceTable(model_path))
    schema = T.StructType([documents.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches):
        import pyarrow as pa

        codec = PieceCodec(table())
        for batch in pieces(batches):
            ids, sizes = codec.encode(_texts(batch.column("text")))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    table = ship(encoded.sparkSession, PieceTable(model_path))
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def decode(batches):
        import pyarrow as pa

        codec = PieceCodec(table())
        for batch in pieces(batches):
            rows = [np.array(ids or [], np.int64) for ids in batch.column("ids").to_pylist()]
            said = codec.decode(np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.decode() for s in said], pa.string())], schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(decode, schema)


def piece_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Each text encoded and decoded again in one pass: its number of ids, and digests of the ids and of the decoded text."""
    table = ship(documents.sparkSession, PieceTable(model_path))
    schema = T.StructType(
        [documents.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def digest(batches):
        import pyarrow as pa

        codec = PieceCodec(table())
        for batch in pieces(batches, size=2 << 20):
            ids, sizes = codec.encode(_texts(batch.column("text")))
            flat, ends = ids.astype("<u4"), np.cumsum(sizes)
            of_ids = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends - sizes, ends, strict=True)]
            of_texts = [hashlib.sha256(s).hexdigest() for s in codec.decode(ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(of_ids), pa.array(of_texts)], schema.names)

    return documents.select("doc_id", "text").mapInArrow(digest, schema)
