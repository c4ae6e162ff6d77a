"""WARC files: exact round trips and chains against payloads that look like records."""

import hashlib

from lumenframe.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def rows():
    same = "é" * 80
    out = [(k, f"http://a/{k}", f"page {k} " + "x" * (37 * k % 900)) for k in range(40)]
    out += [(50, None, None), (51, "u\r\nEvil: 1", ""), (53, "u", same), (52, "u", same), (54, "u", same), (54, "u", same), (55, "u", "short"), (56, "u", "short")]
    out += [(60, "u", FAKE * 3), (61, "u", "a" + FAKE), (62, "u", FAKE.replace("0\r\n", "99999\r\n")), (63, "u", FAKE[:30]), (None, "u", same)]
    # records inside payloads that declare what no reader can hold, and a header longer than a first read
    odd = FAKE.replace("Content-Length: 0\r\n\r\n", "Content-Length: 32\r\n\r\nContent-Length: 1²\r\n\r\nsome text")
    out += [(64, "u", odd), (65, "u", FAKE.replace("999", "9" * 30)), (66, "u", FAKE.replace("0\r\n", "9" * 5000 + "\r\n"))]
    out += [(67, "http://a/" + "long/" * 20_000, "p"), (68, "u", "WARC/1.0\r\n" * 500), (69, "u", FAKE[:90] * 3)]
    return out


def expected(data):
    first = {}
    for k, _, t in data:
        if k is not None and t and len(t.encode()) >= 100:
            first[t] = min(k, first.get(t, k))
    out = []
    for k, _, t in data:
        payload = (t or "").encode()
        original = first.get(t) if k is not None and k != first.get(t) else None
        out.append((k, len(payload), hashlib.sha256(payload).hexdigest(), "response" if original is None else "revisit", original))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    got = warc.archive_round_trip(pages(spark, rows()).repartition(3), f"file://{tmp_path}/w")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows())


def test_any_block_size_gives_the_same_chain(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, rows()).coalesce(1), f"file://{tmp_path}/w")
    want = [r[0] for r in expected(rows())]
    for block in (64, 700, 5000):
        got = warc.read_archives(manifest, block)
        assert sorted((r.page_id for r in got.collect()), key=str) == sorted(want, key=str)
    assert warc.candidates(manifest).count() > len(want)


def test_damage_ends_a_file_and_no_pages_give_no_files(spark, tmp_path):
    import pyarrow.fs as fs

    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages(spark, rows()[:20]).coalesce(1), folder)
    path = tmp_path / "w" / manifest.first().path.rsplit("/", 1)[1]
    data = path.read_bytes()
    at = data.index(b"page 7 ")
    cut = data.rindex(b"Content-Length", 0, data.rindex(b"HTTP", 0, at))
    with fs.LocalFileSystem().open_output_stream(str(path)) as out:
        out.write(data[:cut] + b"C" * 14 + data[cut + 14 :])
    assert sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(7))
    assert warc.archive_round_trip(pages(spark, rows()).limit(0)).count() == 0


class Counting:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        import io

        self.file, self.read_bytes = io.BytesIO(data), 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, many):
        data = self.file.read(many)
        self.read_bytes += len(data)
        return data


def test_headers_planted_in_a_payload_are_not_read_for(spark, tmp_path):
    """500 headers in one payload, each of a record that ends where the true one does."""
    html = "end"
    for k in range(500):
        body = "x" * 400 + html
        html = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(body)}\r\n\r\n" + body
    record = warc._record({"html": html, "page_id": 1, "url": "u", "original": None, "digest": ""})
    for block in (1 << 15, 1 << 20):
        read = 0
        found = []
        for start in range(0, len(record), block):
            file = Counting(record)
            found += warc.block_candidates(file, start, min(len(record), start + block), len(record))
            read += file.read_bytes
        assert len(found) == 501
        file = Counting(record)
        true = next(r for r in found if r["offset"] == 0)
        assert warc.payload(file, true["begin"], true["next"] - 4, False) == (len(html), hashlib.sha256(html.encode()).hexdigest())
        assert read + file.read_bytes <= 3 * len(record)
    got = warc.archive_round_trip(pages(spark, [(1, "u", html), (2, "u", "y")]), f"file://{tmp_path}/w").collect()
    assert sorted(map(tuple, got)) == expected([(1, "u", html), (2, "u", "y")])


def test_originals_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    got = warc.archive_round_trip(pages(spark, rows()), f"file://{tmp_path}/w")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows())
