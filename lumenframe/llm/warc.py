"""WARC archives written by tasks, and read back by boundary-chain verification.

Reading is block-parallel: a task looks at one range of a file and takes every
place where the record magic stands as a candidate, although payloads may hold
the magic too. Each candidate's own header gives the offset of its successor.
Within a block chains are followed in the task; between blocks, pointer jumping
from the start of the file, doubling the reach each round, finds the candidate
at which the true chain enters each block. Records that no chain from the file
start reaches are rejected. Until then only headers are looked at: payloads are
read and digested in a second pass, of reached records alone, so bytes are read
about twice however many headers payloads pretend to hold.

Pages with equal payloads of at least ``least_revisit`` bytes are stored once,
by the page with the smallest id; the others are revisit records.

Defined results: null html is an empty payload; a null url has an empty target;
pages with a null id are stored as responses with a null id and never serve as
the original of others; rows that repeat an id with one payload are all
responses if that id is the smallest; of equal payloads the smallest id is the
original, so there are no ties; a very long payload is written and digested whole,
a piece at a time when read; an empty table gives no files and no rows; after a
damaged record the rest of its file is not returned; only page_id, url and html
are read, so further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import MOST_BROADCAST, intermediates, materialise, new_path, open_store, pieces

MAGIC = b"WARC/1.0\r\n"
#: Bytes that one reading task looks at, and those that are read first of a record's header.
BLOCK, HEADER = 8 << 20, 1 << 12
#: Digits of a length that a record may declare.
DIGITS = 18
#: The most reading tasks; beyond it a task reads several blocks.
MOST_TASKS = 20_000
#: Bytes of a payload that are hashed at a time.
PIECE = 1 << 20


def with_originals(pages: DataFrame, least_revisit: int) -> DataFrame:
    """Pages as (page_id, url, html, digest, original), where original is null for a response.

    Only ids and digests are shuffled. The originals of payloads that several pages
    hold are broadcast; where these are too many, ids are joined to them first, and
    the payloads move only when the revisits are too many as well.
    """
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    read = read.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    shareable = (F.octet_length("html") >= least_revisit) & F.col("page_id").isNotNull()
    keys = materialise(read.where(shareable).select("page_id", "digest"), "warc-digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"))
    first = materialise(first.where("original < last").select("digest", "original"), "warc-originals")
    if first.count() <= MOST_BROADCAST:
        known = read.join(F.broadcast(first), "digest", "left")
        return known.withColumn("original", F.when(shareable & (F.col("page_id") != F.col("original")), F.col("original")))
    revisits = materialise(
        keys.join(first, "digest").where("page_id <> original").select("page_id", F.xxhash64("digest").alias("h"), "original").distinct(),
        "warc-revisits",
    )
    small = revisits.count() <= MOST_BROADCAST
    return read.withColumn("h", F.xxhash64("digest")).join(F.broadcast(revisits) if small else revisits, ["page_id", "h"], "left").drop("h")


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 100) -> DataFrame:
    """Write a record per page, a file per task, below ``folder``; returns the manifest (path, bytes).

    Every attempt of a task writes a file of its own name, and only the files of
    attempts that succeeded are in the manifest, so retries leave no doubles.
    """

    def write(batches):
        import pyarrow as pa

        system, root = open_store(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc"
        size, out = 0, None
        for batch in pieces(batches):
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}")
                record = _record(row)
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size]})

    with intermediates() as kept:
        written = with_originals(pages, least_revisit).select("page_id", "url", "html", "digest", "original")
        return kept(materialise(written.mapInArrow(write, "path string, bytes long"), "warc-manifest"))


def _record(row: dict) -> bytes:
    payload = row["html"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["original"] is not None
    block = http if revisit else http + payload
    url = " ".join((row["url"] or "").split())
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{row['original']}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


CANDIDATE = (
    "file long, block long, offset long, next long, exit long, begin long, page_id long, "
    "record_type string, refers_to long, url string, declared string"
)
RECORD = "file long, offset long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string"


def _until_blank_line(file, most: int, first: int) -> tuple[bytes, bytes, bytes]:
    """What stands before the next blank line, that line's bytes (none if ``most`` bytes hold none), and what else was read."""
    data, step = b"", first
    while len(data) < most:
        data += file.read(min(step, most - len(data)))
        if b"\r\n\r\n" in data:
            break
        step = len(data)
    return data.partition(b"\r\n\r\n")


def _headers(file, data: bytes, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The offset and header of each magic in a block's bytes.

    No header holds a second magic, so the search for blank lines is linear, and
    only the last header of a block may have to be read from beyond it.
    """
    at = data.find(MAGIC)
    while at >= 0:
        after = data.find(MAGIC, at + 1)
        blank = data.find(b"\r\n\r\n", at, after if after >= 0 else len(data))
        if blank >= 0:
            yield start + at, data[at:blank]
        elif after < 0:
            file.seek(start + at)
            head, found, _ = _until_blank_line(file, size - start - at, HEADER)
            if found:
                yield start + at, head
        at = after


def _parse(offset: int, head: bytes, size: int, closed: Callable[[int], bool]) -> dict | None:
    """The candidate at ``offset``, or None if no record of the file can stand there; its payload isn't looked at.

    ``closed`` tells whether a record may end at an offset.
    """
    fields = {}
    for line in head[len(MAGIC) :].split(b"\r\n"):
        key, _, value = line.partition(b":")
        fields[key.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) <= DIGITS):
        return None
    begin = offset + len(head) + 4
    end = begin + int(length)
    if end + 4 > size or not closed(end):
        return None

    def number(key: bytes) -> int | None:
        name = fields.get(key, "").removeprefix("<urn:page:").rstrip(">")
        value = int(name) if name else None
        if value is not None and not -(1 << 63) <= value < 1 << 63:
            raise ValueError(name)
        return value

    try:
        return {
            "offset": offset,
            "next": end + 4,
            "begin": begin,
            "page_id": number(b"warc-record-id"),
            "record_type": fields.get(b"warc-type"),
            "refers_to": number(b"warc-refers-to"),
            "url": fields.get(b"warc-target-uri"),
            "declared": fields.get(b"warc-payload-digest", "").removeprefix("sha256:"),
        }
    except ValueError:
        return None


def block_candidates(file, start: int, stop: int, size: int) -> list[dict]:
    """The candidates that begin in one block of a file, each with where its chain leaves the block."""
    file.seek(start)
    data = file.read(min(size, stop + len(MAGIC) - 1) - start)
    ends: dict[int, bool] = {}

    def closed(end: int) -> bool:
        if end + 4 <= start + len(data):
            return end >= start and data[end - start : end - start + 4] == b"\r\n\r\n"
        if end not in ends:
            file.seek(end)
            ends[end] = file.read(4) == b"\r\n\r\n"
        return ends[end]

    found = [r for offset, head in _headers(file, data, start, size) if (r := _parse(offset, head, size, closed)) is not None]
    leaves: dict[int, int] = {}
    for record in reversed(found):
        after = record["next"]
        record["exit"] = leaves[record["offset"]] = after if after >= stop else leaves.get(after, -1)
    return found


def payload(file, begin: int, end: int, revisit: bool) -> tuple[int, str]:
    """Length and digest of the payload after a record's HTTP header; of a revisit the length that the header declares."""
    file.seek(begin)
    http, blank, body = _until_blank_line(file, end - begin, 4096)
    left = end - begin - len(http) - len(blank) - len(body)
    if revisit:
        declared = 0
        for line in http.split(b"\r\n"):
            value = line[15:].strip()
            if line.lower().startswith(b"content-length:") and value.isdigit() and len(value) <= DIGITS:
                declared = int(value)
        return declared, ""
    digest, many = hashlib.sha256(), 0
    while body or left:
        digest.update(body)
        many += len(body)
        body = file.read(min(left, PIECE)) if left else b""
        left -= len(body)
    return many, digest.hexdigest()


def candidates(manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every place where a record may begin, with its successor and where its chain leaves the block.

    A file is named by the hash of its path. One task reads few blocks, however
    few rows describe them.
    """
    blocks = F.expr(f"(bytes - 1) div {block}L")
    ranges = manifest.where("bytes > 0").select(
        "path", F.xxhash64("path").alias("file"), "bytes", F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("block")
    )

    def look(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            for row in batch.to_pylist():
                system, path = open_store(row["path"])
                start, size = row["block"] * block, row["bytes"]
                with system.open_input_file(path) as file:
                    found = block_candidates(file, start, min(size, start + block), size)
                if found:
                    yield pa.RecordBatch.from_pylist([r | {"file": row["file"], "block": row["block"]} for r in found], _arrow(CANDIDATE))

    return ranges.repartition(_tasks(manifest, block), "file", "block").mapInArrow(look, CANDIDATE)


def _tasks(manifest: DataFrame, block: int) -> int:
    """As many tasks as blocks, up to MOST_TASKS."""
    many = manifest.agg(F.coalesce(F.sum(F.expr(f"(bytes + {block}L - 1) div {block}L")), F.lit(0))).first()[0]
    return max(1, min(many, MOST_TASKS))


def _arrow(columns: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def entries(found: DataFrame, manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """By pointer jumping from the start of each file, where its chain enters blocks: (file, offset)."""
    most = manifest.agg(F.max("bytes")).first()[0] or 0
    start = F.lit(0).cast("long").alias("offset")
    reached = manifest.where("bytes > 0").select(F.xxhash64("path").alias("file"), start)
    jump = found.where("exit >= 0").select("file", "offset", "exit")
    for _ in range((most // block + 1).bit_length()):
        further = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = materialise(reached.unionAll(further).distinct(), "warc-reached")
        ahead = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("beyond"))
        beyond = jump.join(ahead, ["file", "exit"]).select("file", "offset", F.col("beyond").alias("exit"))
        jump = materialise(beyond, "warc-jumps")
    return reached


def read_archives(manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """The records that the chains from the file starts reach, in the columns of RECORD."""
    with intermediates() as kept:
        found = materialise(candidates(manifest, block), "warc-candidates")
        entered = entries(found, manifest, block).withColumn("entered", F.lit(True))
        marked = found.join(entered, ["file", "offset"], "left")

        def follow(group):
            """A block's records from its entry on; its size bounds the group."""
            after = dict(zip(group["offset"], group["next"], strict=True))
            at, keep = next(iter(group["offset"][group["entered"].notna()]), None), set()
            while at in after:
                keep.add(at)
                at = after[at]
            return group[group["offset"].isin(keep)][["file", "offset"]]

        narrow = marked.select("file", "block", "offset", "next", "entered")
        real = narrow.groupBy("file", "block").applyInPandas(follow, "file long, offset long")
        placed = found.join(real, ["file", "offset"]).join(manifest.select("path", F.xxhash64("path").alias("file")), "file")
        placed = placed.repartition(_tasks(manifest, block), "file", "block").sortWithinPartitions("file", "offset")
        return kept(materialise(placed.mapInArrow(_digested, RECORD), "warc-records"))


def _digested(batches):
    """Reached records with the length and digest of their payloads, a file opened once for a run of its records."""
    import pyarrow as pa

    opened, file = None, None
    for batch in pieces(batches):
        out = []
        for row in batch.to_pylist():
            if row["path"] != opened:
                if file is not None:
                    file.close()
                system, path = open_store(row["path"])
                opened, file = row["path"], system.open_input_file(path)
            revisit = row["record_type"] == "revisit"
            many, digest = payload(file, row["begin"], row["next"] - 4, revisit)
            out.append(row | {"payload_bytes": many, "payload_digest": row["declared"] if revisit else digest})
        kind = _arrow(RECORD)
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in kind.names} for r in out], kind)
    if file is not None:
        file.close()


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_revisit: int = 100) -> DataFrame:
    """Write ``pages`` as archives (in the shared folder by default), read them and digest each record."""
    manifest = write_archives(pages, folder or new_path(pages.sparkSession, "warc"), least_revisit)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
