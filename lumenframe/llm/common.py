"""Shared helpers: the cluster's shared folder, written intermediates and folds."""

from __future__ import annotations

import contextlib
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.workspace import pieces, trim  # noqa: F401  for the operators

#: White space and words of the corpus contracts: words are runs of other characters.
ASCII_SPACE = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves if driver and executors are one
    process (``local`` masters, as in tests); elsewhere that is an error, since
    executors would write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenframe-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path for a table or a folder of files in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage at a table that outlives any executor, so a lost executor
    costs only the tasks it was running.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.lumenframe_path = path
    if _SCOPES:
        _SCOPES[-1].append(written)
    return written


_SCOPES: list[list[DataFrame]] = []


def discard(*written: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again; others are left alone."""
    for df in written:
        path = getattr(df, "lumenframe_path", None)
        if path is None:
            continue
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def intermediates() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at the end, the tables materialised within, but for those handed to the function it gives.

    What leaves the block must read kept tables only. After an error nothing is
    deleted, so a retry finds what it may read.
    """
    made: list[DataFrame] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.lumenframe_path)
        return df

    _SCOPES.append(made)
    try:
        yield keep
    except BaseException:
        _SCOPES.pop()
        raise
    _SCOPES.pop()
    discard(*[df for df in made if df.lumenframe_path not in kept])
    if _SCOPES:
        _SCOPES[-1].extend(df for df in made if df.lumenframe_path in kept)


def open_store(uri: str) -> tuple[Any, str]:
    """The file system of a URI and the path in it; for tasks that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", uri))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def spin(key: Column, seed: int = 0) -> Column:
    """A number from 0 up to 1 that a hash of the key gives."""
    bits = F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit((1 << 52) - 1))
    return bits / F.lit(float(1 << 52))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    per_class: int,
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled documents of each class outside the held-out fold, and each class's ids there.

    The choice follows a hash of the id, so reruns agree. Ids with several label
    rows take the larger label, ids with several documents the least text, so there
    is one row an id. Columns: doc_id, text, label. The id list that is
    broadcast has at most twice ``per_class`` rows. No label of the held-out fold
    is used, for the counts either; these include ids that have no document.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id"), modulus) != held_out)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    known = known.withColumn("spin", spin(F.col("doc_id")))
    known = known.where(F.col("label").isin(0, 1))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [
        # the threshold leaves about four times as many ids to be ordered, whatever the class holds
        known.where((F.col("label") == k) & (F.col("spin") * counts.get(k, 0) < 4 * per_class))
        .orderBy("spin", "doc_id")
        .limit(per_class)
        .select("doc_id", "label")
        for k in (0, 1)
    ]
    sample = documents.select("doc_id", "text").join(
        F.broadcast(picked[0].unionAll(picked[1])), "doc_id"
    )
    return sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), counts


def within_bytes(sample: DataFrame, group: str, most: int) -> DataFrame:
    """The rows of a written, bounded sample (doc_id, text, ``group``) that a model may be fitted on in the driver.

    Of each group texts are taken by a hash of the id while they have at most ``most``
    bytes together; texts of more than an eighth of that are passed over.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    sized = sample.select("doc_id", group, size).where(F.col("size") * 8 <= most)
    order = Window.partitionBy(group).orderBy(spin(F.col("doc_id")), "doc_id", "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ids = sized.withColumn("upto", upto).where(F.col("upto") <= most).select("doc_id", group).distinct()
    return sample.join(F.broadcast(ids), ["doc_id", group], "left_semi").select(*sample.columns)  # ids of a bounded sample


#: Ids up to this number are broadcast; more go by a shuffle join.
MOST_BROADCAST = 500_000


def if_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has at most MOST_BROADCAST rows."""
    ids = materialise(ids, "ids")
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a Python object of bounded size; in a task, the result gives it back.

    It travels by value with its class, so executors need no copy of this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
