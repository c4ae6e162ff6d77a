"""Exact Jaccard self-join on word n-grams by partitioning the shingle universe.

Two sets whose Jaccard similarity reaches the threshold differ in at most H
shingles, where H follows from their sizes. Sizes fall into bands; a band hashes
the universe into H + 1 segments, so similar sets agree on at least one segment,
and by the pigeonring argument on one after which, for every k, the next k
segments differ in at most k shingles. A set is indexed in its band, and as a
possible smaller partner in the bands just above, by one signature a segment: the
segment's subset. Segments that hold few shingles agree by chance; there the
signature also takes the next segment, with its one-deletion neighbourhood. Which
segments are extended is decided for each band by a cost estimate from counts
over all documents.

Signatures only propose pairs; each carries parity bits of the next AHEAD
segments, which pairs must nearly share. Members of a signature's group are first
paired with a centre, its most central member. Where that leaves a group in
several components, a member outside the largest one is elected as the next centre
and paired with those of other components. Members that two elections leave apart
are paired with each other, where one is in its own band, as the larger of two that
link is in some group; by then the parity bits have dropped pairs that only share a
passage or agree by chance. Where more than CROWD members of a group are
left apart, as of pages that one template made, they meet only those that agree in
the next segment but for one shingle: the segment's subset and its one-deletion
neighbourhood become the key, of the next two segments and two deletions where a
key is still crowded. A parity bitmap bounds the difference of two sets from below
and drops pairs that cannot link, and what is left is verified on the sets. Sets
with equal shingles are one class throughout, so exact copies, however many, cost
one set.

Words and sets are compared by 64-bit hashes. Defined results: a null or empty
text, or one without words, has an empty set and links with nothing; a very long
text is taken whole, its set and signatures growing with its words; rows with one
id count as one document, with the set of any of its texts; rows with a null id
have their set's size and a null component; of members that weigh the same the
one with the largest id is the centre, which changes no result; an empty table
gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import discard, if_small, intermediates, materialise, pieces
from lumenframe.llm.components import connected_components, extended_components
from lumenframe.llm.textscan import WordScanner, mix, text_buffers

#: The largest size of a band is at least its smallest size times this.
BAND_RATIO = 1.35
#: Longs of a parity bitmap.
BITMAP = 8
#: Segments after a signature's own whose parity it carries, and bits of each; together a long.
AHEAD, AHEAD_BITS = 8, 8
#: Centres that a group with several components is given before its members are paired with each other.
ELECTIONS = 2
#: Members apart beyond which a group's key takes further segments, so the most that one is compared with; and the most segments.
CROWD, FURTHER = 1024, 2
#: The price of a proposed pair, in signatures; the chance that two segments of one shingle are equal.
PAIR_PRICE, EQUAL_SINGLES = 4.0, 1e-3


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least ``num / den``, in integers."""

    num: int
    den: int

    def difference(self, x: int, y: int) -> int:
        """The most shingles in which sets of these sizes can differ and still link."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high``, their segments, and up to how many shingles a segment is extended."""

    number: int
    low: int
    high: int
    segments: int
    light: int = -1


def bands(threshold: Threshold, largest: int) -> list[Band]:
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        most = threshold.difference(low, low)
        while threshold.difference(high + 1, high + 1) == most:
            high += 1
        out.append(Band(len(out), low, high, threshold.difference(high, high) + 1))
        low = high + 1
    return out


def allocate(plan: list[Band], counts: dict[int, tuple[int, int, int, int, int]]) -> list[Band]:
    """For each band the cheapest limit up to which segments are extended.

    ``counts``: by band the sets, shingles, and segments with 0, 1 and 2 shingles.
    """
    out = []
    for band in plan:
        sets, shingles, *few = counts.get(band.number, (0, 0, 0, 0, 0))
        slots = max(1, sets * band.segments)
        share, mean = [c / slots for c in few], shingles / slots

        def cost(light: int) -> float:
            extended = sum(share[: light + 1])
            rows = slots * (1 + extended * (mean + 1))
            pairs = 0.0
            for c, p in enumerate(share):
                equal = EQUAL_SINGLES**c
                if c <= light:
                    equal *= (share[0] + share[1]) ** 2 + EQUAL_SINGLES
                pairs += band.segments * (sets * p) ** 2 / 2 * equal
            return rows + PAIR_PRICE * pairs

        light = min(range(-1, 3), key=cost) if band.segments > 1 else -1
        out.append(Band(band.number, band.low, band.high, band.segments, light))
    return out


class Shingler:
    """The distinct word n-grams of texts as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.scanner = n, WordScanner("space")
        self.odd = mix(np.arange(11, 11 + n + 1, dtype=np.uint64)) | np.uint64(1)

    def __reduce__(self):
        return Shingler, (self.n,)

    def sets(self, column) -> list[np.ndarray]:
        words, _, first = self.scanner.scan(*text_buffers(column))
        words, n = mix(words), self.n
        joined = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            joined += words[k : k + len(joined)] * self.odd[k]
        joined = mix(joined)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(joined[a : b - n + 1]))
            elif b > a:
                parts = words[a:b] * self.odd[: b - a] + self.odd[n : n + 1]
                out.append(mix(parts.sum(dtype=np.uint64, keepdims=True)))
            else:
                out.append(words[:0])
        return out


def set_key(values: np.ndarray) -> np.int64:
    """A hash of a set; with the set's size it names the class of equal sets."""
    return mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)


def parity_bitmap(values: np.ndarray) -> np.ndarray:
    """BITMAP longs; two sets differ in at least as many shingles as their bitmaps in bits."""
    bits = np.bincount((values & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide_bitmap(values: np.ndarray) -> np.ndarray:
    """A parity bitmap with the least power of two of bits, at least 64, that the set's size doesn't exceed."""
    width = max(64, 1 << (len(values) - 1).bit_length())
    bits = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def bitmap_distance(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two parity bitmaps differ, the wider one folded to the other's width."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def segment_of(values: np.ndarray, segments: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _segments(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set's shingles spread anew and ordered by segment, and each segment's number of them and end."""
    segment = segment_of(values, m)
    spread = mix(values[np.argsort(segment, kind="stable")] + np.uint64(0x5851F42D4C957F2D))
    counts = np.bincount(segment, minlength=m)
    return spread, counts, np.cumsum(counts)


def signatures(values: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of one set in one band, with each the parity bits of the next AHEAD segments, and its segment."""
    m = band.segments
    spread, counts, ends = _segments(values, m)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
    sums = total[ends] - total[ends - counts]
    flips = np.uint64(1) << (spread >> np.uint64(40) & np.uint64(AHEAD_BITS - 1))
    bits = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(flips)])
    parity = bits[ends] ^ bits[ends - counts]
    ahead = np.zeros(m, np.uint64)
    for k in range(min(AHEAD, m - 1)):
        ahead |= np.roll(parity, -k - 1) << np.uint64(AHEAD_BITS * k)
    place = mix(np.arange(m, dtype=np.uint64) + np.uint64((band.number + 1) << 32))
    base = mix(sums + place)
    light = np.flatnonzero(counts <= band.light)
    if not len(light):
        return base, ahead, np.arange(m)
    heavy = np.flatnonzero(counts > band.light)
    parts, nexts, places = [base[heavy]], [ahead[heavy]], [heavy]
    for j in light:
        k = (j + 1) % m
        near = np.concatenate([sums[k : k + 1], sums[k] - spread[ends[k] - counts[k] : ends[k]]])
        parts.append(mix(base[j] ^ mix(near)))
        nexts.append(np.full(len(near), ahead[j]))
        places.append(np.full(len(near), j))
    return np.concatenate(parts), np.concatenate(nexts), np.concatenate(places)


def deletions(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` without up to ``most`` (1 or 2) of them, and how many each leaves out."""
    with np.errstate(over="ignore"):
        whole = values.sum(dtype=np.uint64, keepdims=True)
        parts = [whole, whole - values]
        if most > 1:
            i, j = np.triu_indices(len(values), 1)
            parts.append(whole - values[i] - values[j])
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def further_keys(values: np.ndarray, plan: list[Band], wanted: np.ndarray, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each wanted signature of the set: it, its keys with the next ``most`` segments, and how many shingles each leaves out.

    Sets that share the signature and differ in at most ``most`` shingles there share a key.
    """
    out = []
    for band in plan:
        sig, _, places = signatures(values, band)
        sig = sig.view(np.int64)
        mine = np.flatnonzero(np.isin(sig, wanted))
        if not len(mine):
            continue
        spread, counts, ends = _segments(values, band.segments)
        for i in mine:
            after = [(places[i] + k) % band.segments for k in range(1, min(most, band.segments - 1) + 1)]
            sums, left_out = deletions(np.concatenate([spread[ends[k] - counts[k] : ends[k]] for k in after]), most)
            out.append((int(sig[i]), mix(mix(sums + np.uint64(most)) ^ sig[i : i + 1].view(np.uint64)).view(np.int64), left_out))
    return out


def _describe(documents: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """Per document: size and key of its set, bitmap, and how many segments of its band hold 0, 1 and 2 shingles."""
    shingler = Shingler(n)
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("k", T.LongType())]
        + [T.StructField(f"b{i}", T.LongType()) for i in range(BITMAP)]
        + [T.StructField("band", T.IntegerType()), *[T.StructField(f"c{i}", T.LongType()) for i in range(3)]]
    )

    def describe(batches):
        import pyarrow as pa

        plan: list[Band] = []
        for batch in pieces(batches):
            rows = np.zeros((len(batch), 2 + BITMAP + 4), np.int64)
            for i, s in enumerate(shingler.sets(batch.column("text"))):
                if not len(s):
                    rows[i, 2 + BITMAP] = -1
                    continue
                if not plan or plan[-1].high < len(s):
                    plan = bands(threshold, 2 * len(s))
                band = _band(plan, len(s))
                few = np.bincount(np.bincount(segment_of(s, band.segments), minlength=band.segments), minlength=3)[:3]
                rows[i] = [len(s), set_key(s), *parity_bitmap(s), band.number, *few]
            columns = [pa.array(np.ascontiguousarray(c)) for c in rows.T]
            columns[2 + BITMAP] = columns[2 + BITMAP].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema.names)

    return documents.select("doc_id", "text").mapInArrow(describe, schema)


def _band(plan: list[Band], size: int) -> Band:
    return plan[int(np.searchsorted([b.high for b in plan], size))]


def _reach(plan: list[Band], threshold: Threshold):
    """Gives for a size the bands in which its signatures stand: its own, and those above that it can reach."""
    lows = np.array([b.low for b in plan])
    highs = np.array([b.high for b in plan])

    def reach(size: int) -> list[Band]:
        own = int(np.searchsorted(highs, size))
        above = int(np.searchsorted(lows * threshold.num, size * threshold.den, "right"))
        return [band for band in plan[own:above] if band.segments > 1]

    return reach


def _index(documents: DataFrame, n: int, threshold: Threshold, plan: list[Band]) -> DataFrame:
    """Rows (sig, k, m, ahead): the signatures of every class in its band and in those above that it can reach.

    ``m`` is the set's size, negative in a band above its own: a bit that takes no room in the shuffle.
    """
    shingler, reach = Shingler(n), _reach(plan, threshold)

    def index(batches):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for batch in pieces(batches):
            found, keys, sizes = [], [], []
            for s in shingler.sets(batch.column("text")):
                key = (int(set_key(s)), len(s))
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                for band in reach(len(s)):
                    found.append(signatures(s, band))
                    keys.append(key[0])
                    sizes.append(len(s) if len(s) >= band.low else -len(s))
            if not found:
                continue
            many = [len(f[0]) for f in found]
            sig, ahead, _ = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [sig.view(np.int64), np.repeat(np.array(keys, np.int64), many), np.repeat(np.array(sizes, np.int32), many), ahead.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "k", "m", "ahead"])

    return documents.select("text").mapInArrow(index, "sig long, k long, m int, ahead long")


def _further(rows: DataFrame, documents: DataFrame, n: int, threshold: Threshold, plan: list[Band], most: int) -> DataFrame:
    """The members (first, id, ahead, own, component) of crowded groups by keys with ``most`` further segments.

    ``first`` is a group's signature. The result has the key as ``sig``, and ``out``, how many shingles the key leaves out;
    keys that only one component has are dropped. What a document has in ``wanted`` is bounded by its own signatures.
    """
    shingler, reach = Shingler(n), _reach(plan, threshold)
    wanted = rows.groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("first").alias("wanted"))

    def read(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            found = []
            sets = shingler.sets(batch.column("text"))
            for i, (s, sigs) in enumerate(zip(sets, batch.column("wanted").to_pylist(), strict=True)):
                for first, keys, left_out in further_keys(s, reach(len(s)) if len(s) else [], np.array(sigs, np.int64), most):
                    found.append((np.full(len(keys), i), np.full(len(keys), first), keys, left_out))
            if found:
                at, *columns = (pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *columns], ["id", "first", "sig", "out"])

    named = documents.select("doc_id", "text").join(wanted, "doc_id")
    kind = T.StructType([T.StructField("id", documents.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("first", "sig", "out")]])
    keyed = named.mapInArrow(read, kind).groupBy("first", "id", "sig").agg(F.min("out").alias("out"))
    keyed = keyed.join(rows.select("first", "id", "ahead", "own", "component"), ["first", "id"])
    return _apart(keyed)


def _described_sets(pairs: DataFrame, documents: DataFrame, n: int, describe) -> DataFrame:
    """Rows (k, n, v) with ``describe`` of the set of each document that the pairs name."""
    shingler = Shingler(n)
    ids = if_small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def read(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            sets = shingler.sets(batch.column("text"))
            columns = [
                pa.array([set_key(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([describe(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n", "v"])

    named = documents.select("doc_id", "text").join(ids, "doc_id").select("text")
    return named.mapInArrow(read, "k long, n int, v binary").dropDuplicates(["k", "n"])


def _tested(pairs: DataFrame, documents: DataFrame, n: int, describe, test) -> DataFrame:
    """The pairs whose descriptions and sizes pass ``test``."""
    described = materialise(_described_sets(pairs, documents, n, describe), "join-described")
    names = pairs.columns
    for x in "ab":
        side = described.select(F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("v").alias(f"v{x}"))
        pairs = pairs.join(side, [f"k{x}", f"n{x}"])

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            values = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("va", "vb")]
            sizes = [batch.column(c).to_pylist() for c in ("na", "nb")]
            keep = [test(*row) for row in zip(*values, *sizes, strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    kind = T.StructType([pairs.schema[c] for c in names])
    return materialise(pairs.select(*names, "va", "vb").mapInArrow(run, kind), "join-tested")


def _links(pairs: DataFrame, documents: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the threshold; pairs: ka, na, a, kb, nb, b.

    First by bitmaps as wide as the sets, a 64th of their bytes; few pairs need the sets themselves.
    """

    def near(x, y, a, b):
        return bitmap_distance(x, y) <= threshold.difference(a, b)

    def linked(x, y, a, b):
        both = int(np.isin(x, y, assume_unique=True).sum())
        return threshold.den * both >= threshold.num * (a + b - both)

    likely = _tested(pairs, documents, n, wide_bitmap, near)
    return _tested(likely, documents, n, lambda s: s, linked).select("a", "b")


def _possible(threshold: Threshold, l: str, r: str):  # noqa: E741
    """Whether two classes with bitmaps can link, by sizes and by the bitmaps' distance."""
    x, y = F.col(f"{l}.n"), F.col(f"{r}.n")
    apart = F.lit(0)
    for i in range(BITMAP):
        apart = apart + F.bit_count(F.col(f"{l}.b{i}").bitwiseXOR(F.col(f"{r}.b{i}")))
    most = F.floor((x + y) * (threshold.den - threshold.num) / (threshold.den + threshold.num))
    return (threshold.den * F.least(x, y) >= threshold.num * F.greatest(x, y)) & (apart <= most)


def _follows(x: str, y: str):
    """Whether the next k segments can differ in at most k shingles, for every k up to AHEAD."""
    apart, near = F.col(x).bitwiseXOR(F.col(y)), F.lit(True)
    for k in range(1, AHEAD + 1):
        mask = (1 << AHEAD_BITS * k) - 1
        near = near & (F.bit_count(apart.bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))) <= k)
    return near


def _pair(l: str, r: str) -> list:  # noqa: E741
    """The columns of a pair, the lesser id first."""
    swap = F.col(f"{l}.id") > F.col(f"{r}.id")
    one = lambda c, name: F.when(swap, F.col(f"{r}.{c}")).otherwise(F.col(f"{l}.{c}")).alias(name)
    two = lambda c, name: F.when(swap, F.col(f"{l}.{c}")).otherwise(F.col(f"{r}.{c}")).alias(name)
    return [one("k", "ka"), one("n", "na"), one("id", "a"), two("k", "kb"), two("n", "nb"), two("id", "b")]


def _parted(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of groups that lie in several of the components found, with their component and the group's largest one."""
    placed = members.select("sig", "id", "ahead", "own", "weight").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "sig", "id", "ahead", "own", "weight", F.coalesce("component", "id").alias("component")
    )
    return materialise(_apart(placed), "join-parted")


def _apart(placed: DataFrame) -> DataFrame:
    """The rows of groups with several components, with the group's largest one as ``main``."""
    parts = placed.groupBy("sig", "component").agg(F.count("*").alias("many"))
    parts = parts.groupBy("sig").agg(F.max(F.struct("many", "component")).alias("top"), F.count("*").alias("parts"))
    several = parts.where("parts > 1").select("sig", F.col("top.component").alias("main"))
    return placed.join(several, "sig")


def _met(every: DataFrame, bits: DataFrame, threshold: Threshold, most: int) -> DataFrame:
    """The pairs that can link of a group's members outside its main component with all of other components.

    One of a pair is in its own band: two sets that link meet in the larger one's, and pairs that share
    signatures there mostly do so in the bands above as well.
    """
    every = every.join(bits, "id")
    return (
        every.where("component <> main")
        .alias("l")
        .join(
            every.alias("r"),
            (F.col("l.sig") == F.col("r.sig"))
            & (F.col("l.component") != F.col("r.component"))
            & (F.col("l.own") | F.col("r.own"))
            & ((F.col("r.component") == F.col("r.main")) | (F.col("l.id") < F.col("r.id")))
            & (F.col("l.out") + F.col("r.out") <= most)
            & _follows("l.ahead", "r.ahead")
            & _possible(threshold, "l", "r"),
        )
        .select(*_pair("l", "r"))
    )


def _components(documents: DataFrame, described: DataFrame, classes: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """(id, component) of the classes that links join to others."""
    known = described.where("n > 0 and doc_id is not null")
    # a few rows a band; the number of bands grows with the logarithm of the longest text
    counted = known.groupBy("band").agg(F.count("*"), F.sum("n"), *[F.sum(f"c{i}") for i in range(3)], F.max("n")).collect()
    counts = {r[0]: tuple(r[1:6]) for r in counted}
    plan = allocate(bands(threshold, max([1, *(r[6] for r in counted)])), counts)
    # One shuffle of signatures serves both the count of their groups and the way back to their members;
    # both read all columns, else they would not be one exchange.
    index = _index(documents, n, threshold, plan).repartition("sig")
    groups = (
        index.groupBy("sig")
        .agg(
            F.min(F.struct("k", "m", "ahead")).alias("low"),
            F.max(F.struct("k", "m", "ahead")).alias("high"),
            F.max("m").alias("own"),
            F.count("*").alias("members"),
        )
        .where("low <> high and own > 0")  # a group without a set of its band holds no pair that doesn't meet elsewhere
        .select("sig", "members")
    )
    sized = ["sig", "k", F.abs("m").alias("n"), (F.col("m") > 0).alias("own"), "ahead", "members"]
    shared = materialise(index.join(groups, "sig").select(*sized), "join-groups")
    weights = shared.groupBy("k", "n").agg(F.sum("members").alias("weight"))
    nodes = materialise(classes.join(weights, ["k", "n"]), "join-nodes")
    members = materialise(shared.select("sig", "k", "n", "own", "ahead").distinct().join(nodes.select("k", "n", "id", "weight"), ["k", "n"]).drop("k", "n"), "join-members")
    discard(shared)
    bits = nodes.select("id", "k", "n", *[f"b{i}" for i in range(BITMAP)])

    def possible(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
        """The distinct pairs (l, r) of ids that can link and have not been tested."""
        named = pairs.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
        named = named.join(bits.alias("x"), F.col("l") == F.col("x.id")).join(bits.alias("y"), F.col("r") == F.col("y.id"))
        named = named.where(_possible(threshold, "x", "y")).select(*_pair("x", "y"))
        return materialise(named if tested is None else named.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "join-pairs")

    def starred(rows: DataFrame, centre: DataFrame) -> DataFrame:
        """Members paired with the centre of their group, those of the centre's own component left out."""
        near = rows.join(centre, "sig").where((F.col("id") != F.col("centre")) & _follows("ahead", "centre_ahead"))
        near = near.where(F.col("component") != F.col("centre_component")) if "component" in rows.columns else near
        return near.select(F.col("id").alias("l"), F.col("centre").alias("r"))

    def elected(rows: DataFrame) -> DataFrame:
        fields = [c for c in ("weight", "id", "ahead", "component") if c in rows.columns]
        best = rows.groupBy("sig").agg(F.max(F.struct(*fields)).alias("c"))
        return best.select("sig", F.col("c.id").alias("centre"), *[F.col(f"c.{c}").alias(f"centre_{c}") for c in fields[2:]])

    tested = possible(starred(members, elected(members)), None)
    found = connected_components(_links(tested, documents, n, threshold), "a", "b")
    for _ in range(1, ELECTIONS):
        members = _parted(members, found)
        again = possible(starred(members, elected(members.where("component <> main"))), tested)
        tested, found = tested.unionAll(again), extended_components(found, _links(again, documents, n, threshold), "a", "b")

    # Members that no centre joined meet the members of their groups that are still in other components.
    every = _parted(members, found).select("sig", F.col("sig").alias("first"), "id", "ahead", "own", "component", "main", F.lit(0).cast("long").alias("out"))
    met = []
    for most in range(FURTHER + 1):
        crowded = every.where("component <> main").groupBy("sig").agg(F.count("*").alias("many")).where(F.col("many") > CROWD).select("sig")
        crowded = if_small(crowded) if most < FURTHER else None
        if crowded is None or crowded.isEmpty():
            met.append(_met(every, bits, threshold, most))
            break
        met.append(_met(every.join(crowded, "sig", "left_anti"), bits, threshold, most))
        kept_back = every.join(crowded, "sig").select("first", "id", "ahead", "own", "component").distinct()
        every = materialise(_further(kept_back, documents, n, threshold, plan, most + 1), "join-further")
    rest = met[0]
    for more in met[1:]:
        rest = rest.unionAll(more)
    rest = rest.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    last = _links(materialise(rest, "join-rest"), documents, n, threshold)
    return extended_components(found, last, "a", "b").withColumnRenamed("node", "id")


def similar_documents(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Every document with the size of its set and its component of linked documents.

    Columns: doc_id, n_shingles, component_id (the least id that links reach).
    """
    threshold = Threshold(num, den)
    with intermediates() as kept:
        described = kept(materialise(_describe(documents, n, threshold), "join-sizes"))
        known = described.where("n > 0 and doc_id is not null")
        classes = kept(
            materialise(
                known.groupBy("k", "n").agg(F.min("doc_id").alias("id"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(BITMAP)]),
                "join-classes",
            )
        )
        component = kept(materialise(_components(documents, described, classes, n, threshold), "join-components"))
    named = classes.join(component, "id", "left").select("k", "n", F.coalesce("component", "id").alias("component_id"))
    return (
        described.select("doc_id", "n", "k")
        .join(named, ["k", "n"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


def one_of_each_group(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that link, directly or not, to a document with a smaller id."""
    found = similar_documents(documents, n, num, den)
    gone = if_small(found.where("doc_id <> component_id").select("doc_id").distinct())
    return documents.join(gone, "doc_id", "left_anti")
