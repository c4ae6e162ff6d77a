"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table,
``(offset + turn * skip) mod size``. Shards take turns claiming the first slot
of their order that is still free, so loads differ by at most one slot and a
shard that leaves moves few other keys. The table has a fixed size, whatever
the data, so it is broadcast and each row finds its shard by one hash lookup.

Defined results: a null key counts as the empty text; equal keys share a shard;
an empty input gives no rows; columns of the input keep their names, and the
added columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over a hundred times the usual number of shards.
TABLE_SIZE = 65537


def _draw(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard index of each of ``size`` (prime) slots."""
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and no more than slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    slot = [_draw(s, "offset") % size for s in shards]
    skip = [_draw(s, "skip") % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int32)
    left = size
    while left:
        for k in range(len(shards)):
            while table[slot[k]] >= 0:
                slot[k] = (slot[k] + skip[k]) % size
            table[slot[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 15 hex digits of its md5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    digits = F.substring(F.md5(text.cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % size).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """Rows (slot, shard_id, shard), one for each slot."""
    table = fill_table(shards, size)
    rows = [(i, int(k), shards[k]) for i, k in enumerate(table)]
    return spark.createDataFrame(rows, "slot int, shard_id int, shard string")


def assign_shards(
    df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE
) -> DataFrame:
    """``df`` with slot, shard_id and shard; one broadcast lookup, no shuffle."""
    table = F.broadcast(lookup_table(df.sparkSession, shards, size))
    kept = df.drop("shard_id", "shard").withColumn("slot", slot_of(F.col(key), size))
    return kept.join(table, "slot").select(*kept.columns, "shard_id", "shard")
