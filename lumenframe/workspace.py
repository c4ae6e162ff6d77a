"""Scratch folders for files and checkpoints of streams, pieces of Arrow batches, and rows dealt to all cores."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """An unused folder in ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine serves if driver and executors are
    one process (``local`` masters, as in tests); elsewhere that is an error.
    """
    base, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="lumenframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pieces(batches: Iterator[Any], rows: int = 500, size: int = 8 << 20, tidy: bool = True) -> Iterator[Any]:
    """The rows of Arrow batches, at most ``rows`` and about ``size`` bytes at a time.

    Keeps what a task works on at once small, whatever the session's batches hold;
    Spark itself limits those by bytes. A row of more than ``size`` bytes comes alone.
    At the end of a task the worker gives back what it has freed, unless ``tidy`` is
    off, for a stage whose next task needs as much again.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    if tidy:
        trim()


def trim() -> None:
    """Return freed memory to the machine, which a worker would hold while it waits for a task of another stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # of the GNU C library
        libc.malloc_trim(0)


#: Tasks for each core that rows are dealt to, so that an uneven one doesn't hold up the rest.
TASKS_PER_CORE = 4


def deal(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a hash of the key to as many tasks as keep all cores busy.

    Small rows of which images or files are made stand in few input splits, however
    many they are; the number is given, else adaptive execution would join small parts.
    """
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, key)
