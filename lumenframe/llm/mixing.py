"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold
them. The patterns' words flow to the sources' quotas: a first copy of a pattern
costs less than a second, so repetition is used only where quotas need it, and
least for texts that other sources repeat too. The flow network has one node a
pattern and a source, not a document; documents are then selected in an order
seeded by their ids.

Sources overlap where they hold equal texts: each row then supplies its own
source, and its pattern is every source with that text. Or an array of sources is
given for each row, which may supply any of them.

Defined results: a null text has no words and is never taken; texts are counted
whole, however long, and a document longer than its source's target is taken only
if that brings the source nearer; a null source is a source of its own, last in
order; rows repeated with one id are separate documents; which of rows that are
equal in id and text is taken first doesn't matter; an empty table gives no rows;
columns that are not read do not matter, whatever their names.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.common import if_small, intermediates, materialise, spin

#: Most membership patterns (by own source) that the driver accepts; sources of a mix are few by nature.
MOST_PATTERNS = 100_000
#: Documents in a bucket of the seeded order: at least this many, and four times the root of the pattern's documents.
BUCKET = 2_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def targets(
    sizes: dict[str | None, int], weights: tuple[int, ...], share: Fraction, repeats: int
) -> dict[str | None, Fraction]:
    """Words wanted of each source: by weight, at most ``repeats`` times its size.

    Weights follow the sources by code point, null last. What a source at its
    limit cannot take is shared again by weight among the others.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > repeats * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def route(
    capacity: dict[tuple, int], quota: dict, repeats: int, room: dict[tuple[tuple, object], int] | None = None
) -> dict[tuple[tuple, object], int]:
    """Words that flow from each pattern to each of its sources, at least total cost.

    ``capacity`` is words of one copy by pattern; ``room`` is how many of these each
    of its sources can take, all by default. Patterns that share no source,
    directly or by others, form networks of their own, so many small ones stay cheap.
    """
    top: dict[object, object] = {s: s for p in capacity for s in p}

    def find(s: object) -> object:
        while top[s] != s:
            top[s] = top[top[s]]
            s = top[s]
        return s

    for p in capacity:
        for s in p[1:]:
            top[find(s)] = find(p[0])
    parts: dict[object, tuple[dict, dict]] = {}
    for p, words in capacity.items():
        if p:
            parts.setdefault(find(p[0]), ({}, {}))[0][p] = words
    for s in top:
        if s in quota:
            parts[find(s)][1][s] = quota[s]
    flow: dict[tuple[tuple, object], int] = {}
    for patterns, quotas in parts.values():
        flow |= least_cost_flow(patterns, quotas, repeats, room)
    return flow


def least_cost_flow(
    capacity: dict[tuple, int], quota: dict, repeats: int, room: dict[tuple[tuple, object], int] | None = None
) -> dict[tuple[tuple, object], int]:
    """The greatest flow of least cost, copy k of a pattern costing k a word, so costs are convex.

    Only edges out of the start have a cost, so paths of one cost are saturated
    together: one maximum flow (Dinic, 1970) for each further copy.
    """
    patterns, sources = list(capacity), list(quota)
    node = {("p", p): k + 2 for k, p in enumerate(patterns)}
    node |= {("s", s): k + 2 + len(patterns) for k, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(node))]
    to: list[int] = []
    left: list[int] = []

    def edge(a: int, b: int, most: int) -> int:
        for x, y, r in ((a, b, most), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            left.append(r)
        return len(to) - 2

    supply = {p: edge(0, node["p", p], 0) for p in patterns}
    middle = {
        (p, s): edge(node["p", p], node["s", s], repeats * (capacity[p] if room is None else room.get((p, s), 0)))
        for p in patterns
        for s in p
        if s in quota
    }
    for s in sources:
        edge(node["s", s], 1, quota[s])

    def levels() -> list[int]:
        far, queue = [-1] * len(graph), deque([0])
        far[0] = 0
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if left[e] and far[to[e]] < 0:
                    far[to[e]] = far[x] + 1
                    queue.append(to[e])
        return far

    for _ in range(repeats):
        for p, e in supply.items():
            left[e] += capacity[p]
        while (far := levels())[1] >= 0:
            turn, path, x = [0] * len(graph), [], 0
            while True:
                if x == 1:
                    most = min(left[e] for e in path)
                    for e in path:
                        left[e] -= most
                        left[e ^ 1] += most
                    full = next(k for k, e in enumerate(path) if not left[e])
                    x = to[path[full] ^ 1]
                    del path[full:]
                edges = graph[x]
                while turn[x] < len(edges) and not (left[edges[turn[x]]] and far[to[edges[turn[x]]]] == far[x] + 1):
                    turn[x] += 1
                if turn[x] < len(edges):
                    path.append(edges[turn[x]])
                    x = to[path[-1]]
                elif path:
                    x = to[path.pop() ^ 1]
                    turn[x] += 1
                else:
                    break
    return {k: left[e ^ 1] for k, e in middle.items()}


def _within(rows: DataFrame, key: list[str], amount: Column, limit: str) -> DataFrame:
    """``rows`` with ``chosen``: whether the sum of ``amount`` up to the row, in the seeded order of its key, is within ``limit``.

    Rows follow the order in buckets of spin, so a key with any number of rows is
    summed in parallel: totals of buckets are few, and running sums stay within a bucket.
    """
    rows = rows.withColumn("amount", amount)
    totals = rows.groupBy(*key, "bucket").agg(F.sum("amount").alias("sum"))
    by_bucket = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, "bucket", F.coalesce(F.sum("sum").over(by_bucket), F.lit(0)).alias("before"))
    order = [c for c in ("spin", "doc_id", "size", "h1") if c in rows.columns]
    within = Window.partitionBy(*key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "bucket"]]
    return (
        rows.withColumn("run", F.sum("amount").over(within))
        .alias("a")
        .join(before.alias("b"), same)
        .select("a.*", (F.col("a.run") + F.col("b.before") <= F.col(f"a.{limit}")).alias("chosen"))
        .drop("run", "amount")
    )


def _nearest(parts: DataFrame) -> DataFrame:
    """Choose rows of each cell p so that the sizes chosen of each source s sum near its goal.

    ``parts``: p, s, doc_id, size, spin, bucket, goal (of p), goal_s, row. Rows
    whose running sum in the seeded order is within their cell's goal are chosen;
    then others of the source as long as any fits; then single rows or pairs are
    moved in or out as long as that brings the source nearer.
    """
    chosen = materialise(_within(parts, ["p"], F.col("size"), "goal"), "mix-chosen")
    gap = (F.first("goal_s") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap")
    chosen = materialise(_flipped(chosen, _fitting(chosen, chosen.groupBy("s").agg(gap), ["s"])), "mix-filled")
    return _flipped(chosen, _closing(chosen, chosen.groupBy("s").agg(gap), ["s"]))


def _flipped(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """``chosen`` after the named rows are moved in or out."""
    return chosen.join(rows.select("row", F.lit(True).alias("moved")), "row", "left").select(
        *[c for c in chosen.columns if c != "chosen"],
        F.when(F.col("moved"), ~F.col("chosen")).otherwise(F.col("chosen")).alias("chosen"),
    )


def _fitting(chosen: DataFrame, gaps: DataFrame, key: list[str]) -> DataFrame:
    """Rows to take beyond ``chosen``, until no row is left that fits what its key lacks.

    A round takes rows of at most half of the gap while their running sum is
    within it, or, if all are larger, the first that fits. So the gap is halved,
    or only rows of more than half of it are left, of which one fits at most:
    rounds grow with the logarithm of the gap, not with the rows.
    """
    names = [*key, "row", "doc_id", "size", "spin", "bucket"]
    rows, picked = chosen.where("not chosen and size > 0").select(*names), []
    while True:
        rows = rows.join(F.broadcast(gaps), key).where("size <= gap")  # gaps: MOST_PATTERNS rows at most
        rows = materialise(rows, "mix-left")
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, picked) if picked else rows.select("row")
        half = F.when(F.min("size") * 2 <= F.first("gap"), F.first("gap") / 2).otherwise(F.first("gap"))
        caps = F.broadcast(rows.groupBy(*key).agg(half.alias("cap")))
        tried = rows.join(caps, key).where("size <= cap").drop("cap")
        taken = materialise(_within(tried, key, F.col("size"), "gap").where("chosen").select(*key, "row", "size"), "mix-fitting")
        picked.append(taken.select("row"))
        spent = F.broadcast(taken.groupBy(*key).agg(F.sum("size").alias("spent")))  # each key with rows takes one at least
        gaps = rows.select(*key, "gap").distinct().join(spent, key).select(*key, (F.col("gap") - F.col("spent")).alias("gap"))
        rows = rows.select(*names).join(taken.select("row"), "row", "left_anti")


def _closing(chosen: DataFrame, gaps: DataFrame, key: list[str]) -> DataFrame:
    """Rows to move in or out so that no single row and no exchange of two brings a key nearer.

    The search sees how many rows of each size are in and out, whatever their
    number; sizes that differ are few, about the root of twice a key's words at
    most. Of rows of one size the first in the seeded order are moved.
    """
    count = lambda which: F.count(F.when(which, 1))
    open_keys = F.broadcast(gaps.where("gap <> 0"))
    sizes = chosen.where("size > 0").join(open_keys, key)
    sizes = sizes.groupBy(*key, "size", "gap").agg(count(F.col("chosen")).alias("taken"), count(~F.col("chosen")).alias("free"))
    kinds = chosen.select(*key, F.lit(0).cast("long").alias("size"), F.lit(True).alias("chosen"), F.lit(0).cast("long").alias("n")).schema

    def search(table):
        import pyarrow as pa

        table = table.sort_by("size")
        size, taken, free = (table.column(c).to_numpy() for c in ("size", "taken", "free"))
        change = closing_moves(size, taken, free, table.column("gap")[0].as_py())
        at = np.flatnonzero(change)
        columns = [table.column(k).take(pa.array(at)) for k in key]
        return pa.table([*columns, pa.array(size[at]), pa.array(change[at] < 0), pa.array(abs(change[at]))], kinds.names)

    moves = materialise(sizes.groupBy(*key).applyInArrow(search, kinds), "mix-moves")
    same = [*key, "size", "chosen"]
    rows = chosen.select(*same, "row", "doc_id", "spin", "bucket").join(F.broadcast(moves), same)
    rows = rows.withColumnRenamed("chosen", "side")
    return _within(rows, [*key, "size", "side"], F.lit(1), "n").where("chosen").select("row")


def closing_moves(sizes: np.ndarray, taken: np.ndarray, free: np.ndarray, gap: int) -> np.ndarray:
    """Change of the number taken of each size, by the best move or exchange as long as one leaves a smaller gap.

    ``sizes`` ascend and are positive; ``taken`` and ``free`` count the documents
    of each. Of equal results the one that moves fewer documents is used.
    """
    now, left = taken.astype(np.int64), free.astype(np.int64)
    while gap:
        into, out = np.flatnonzero(left), np.flatnonzero(now)
        a, b = np.append(0, sizes[into]), np.append(0, sizes[out])
        place = np.searchsorted(b, a - gap)
        pairs = np.stack([np.maximum(place - 1, 0), np.minimum(place, len(b) - 1)])
        after = abs(gap - a + b[pairs])
        cost = 4 * after + (a > 0) + (pairs > 0)
        side, i = np.unravel_index(np.argmin(cost), cost.shape)
        j = pairs[side, i]
        if after[side, i] >= abs(gap):
            break
        gap = int(gap - a[i] + b[j])
        for k, by in [(k, 1) for k in into[:i][-1:]] + [(k, -1) for k in out[:j][-1:]]:
            now[k] += by
            left[k] -= by
    return now - taken


def _cells(documents: DataFrame, membership: Column | None, source: Column | None, seed: int) -> DataFrame:
    """Every document's size, place in the seeded order, pattern and, where rows supply one source only, that source.

    Texts are compared by 128 bits of hashes. Few texts stand in several sources,
    so those are looked up from a small table and the rest keep their own.
    """
    key = [F.xxhash64(F.lit(f"{seed}{k}"), "doc_id", "text").alias(f"h{k}") for k in (1, 2)]
    text = [F.xxhash64(F.lit(k), "text").alias(f"t{k}") for k in (1, 2)]
    given = F.array_sort(F.array_distinct(membership)) if membership is not None else F.array(source)
    narrow = materialise(
        documents.select(
            "doc_id",
            (F.lit(None) if source is None else source).cast("string").alias("own"),
            F.coalesce(given, F.array()).cast("array<string>").alias("pattern"),
            word_count(F.col("text")).alias("size"),
            spin(F.col("doc_id"), seed).alias("spin"),
            F.monotonically_increasing_id().alias("row"),
            *key,
            *text,
        ),
        "mix-sizes",
    )
    if membership is not None:
        return narrow.drop("t1", "t2")
    holders = narrow.where("size > 0").groupBy("t1", "t2").agg(F.collect_set(F.struct("own")).alias("holders"))
    several = if_small(holders.where(F.size("holders") > 1))
    shared = F.transform(F.array_sort("holders"), lambda x: x.getField("own"))
    joined = narrow.join(several, ["t1", "t2"], "left").withColumn("pattern", F.coalesce(shared, "pattern"))
    return materialise(joined.select(*[c for c in narrow.columns if c not in ("t1", "t2")]), "mix-patterns")


def mix_sources(
    documents: DataFrame,
    membership: Column | None = None,
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    repeats: int = 2,
    seed: int = 7,
    source: Column | None = None,
) -> DataFrame:
    """For every document its words, its source's size and target, and the words taken.

    Given ``source``, a row supplies that source, and sources that hold its text
    overlap. Given ``membership``, an array of sources, a row supplies any of them,
    and the size and target are those of the first. ``taken`` is ``copies`` times
    the size, at most ``repeats`` times. What flows from a pattern decides how many
    of its words are taken: whole copies of all its documents first, the rest from
    documents in seeded order. Rows are told apart by ``h1`` and ``h2``, hashes of
    id and text.
    """
    if (membership is None) == (source is None):
        raise ValueError("give either source or membership")
    with intermediates() as kept:
        return kept(materialise(_mixed(_cells(documents, membership, source, seed), source is not None, weights, share, repeats), "mix-taken"))


def _mixed(narrow: DataFrame, own: bool, weights: tuple[int, ...], share: Fraction, repeats: int) -> DataFrame:
    table = narrow.groupBy("pattern", "own").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MOST_PATTERNS + 1).collect()
    if len(table) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity: dict[tuple, int] = {}
    sizes: dict[str | None, int] = {}
    for r in table:
        p = tuple(r.pattern)
        capacity[p] = capacity.get(p, 0) + int(r.words)
        for s in (r.own,) if own else p:
            sizes[s] = sizes.get(s, 0) + int(r.words)
    wanted = targets(sizes, weights, share, repeats)
    room = {(tuple(r.pattern), r.own): int(r.words) for r in table} if own else None
    flow = route(capacity, {s: round(t) for s, t in wanted.items()}, repeats, room)
    of_pattern: dict[tuple, int] = {}
    for (p, _), words in flow.items():
        of_pattern[p] = of_pattern.get(p, 0) + words
    plan, goals = [], {}
    for number, r in enumerate(table):
        p, words = tuple(r.pattern), int(r.words)
        first = r.own if own else p[0] if p else None
        sent = flow.get((p, r.own), 0) if own else of_pattern.get(p, 0)
        # the last copy always counts as chosen documents, so that each document can be moved in or out
        whole = min(sent // words, repeats - 1) if words else 0
        goal, group = sent - whole * words, ("own", r.own) if own else ("pattern", p)
        goals[group] = goals.get(group, 0) + goal
        buckets = -(-r.rows // max(BUCKET, 4 * int(r.rows**0.5)))
        plan.append([list(p), r.own, number, group, whole, goal, buckets, sizes.get(first, 0), float(wanted.get(first, 0))])
    groups = {g: k for k, g in enumerate(goals)}
    planned = narrow.sparkSession.createDataFrame(
        [(*row[:3], groups[row[3]], *row[4:6], goals[row[3]], *row[6:]) for row in plan],
        "pattern array<string>, own string, p int, s int, whole long, goal long, goal_s long, buckets int, source_size long, target double",
    )
    same = (F.col("a.pattern") == F.col("b.pattern")) & F.col("a.own").eqNullSafe(F.col("b.own"))
    parts = narrow.alias("a").join(F.broadcast(planned).alias("b"), same)  # MOST_PATTERNS rows at most
    parts = parts.withColumn("bucket", F.pmod("h1", F.col("buckets").cast("long")).cast("int")).drop("pattern", "own", "buckets")
    chosen = _nearest(parts)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("chosen").cast("long")).otherwise(0).cast("int")
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "h1", "h2")


def take_copies(documents: DataFrame, membership: Column | None = None, seed: int = 7, **settings) -> DataFrame:
    """The rows of ``documents`` that the mix takes, repeated as often as it takes them.

    Copies of rows that are equal in id and text are dealt to them evenly, so the
    words taken are those of the mix. Documents without words are not taken.
    """
    mixed = mix_sources(documents, membership, seed=seed, **settings)
    counts = mixed.groupBy("h1", "h2").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").cast("int").alias("many"))
    counts = if_small(counts.where("copies > 0"))
    packed = documents.select(
        F.struct(*[F.col(c) for c in documents.columns]).alias("row"),
        *[F.xxhash64(F.lit(f"{seed}{k}"), "doc_id", "text").alias(f"h{k}") for k in (1, 2)],
    )
    found = packed.join(counts, ["h1", "h2"])
    each = F.floor(F.col("copies") / F.col("many")).cast("int")
    rows = found.where("copies % many = 0").select("row", each.alias("copies"))
    if not counts.where("copies % many <> 0").isEmpty():
        place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.lit(0)))
        dealt = found.where("copies % many <> 0").withColumn("place", place)
        extra = (F.col("place") <= F.col("copies") % F.col("many")).cast("int")
        rows = rows.unionAll(dealt.select("row", (each + extra).alias("copies")).where("copies > 0"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
