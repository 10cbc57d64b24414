import hashlib
import io
import zlib

import pytest

from stormcell.llm import warc
from stormcell.session import scratch_path

from .samples import frame, prose

SCHEMA = "page_id long, url string, html string, _uid string, offset string"


def pages():
    big = prose(1, 60_000)
    a, b = prose(2, 40), prose(3, 200)
    rows = [(5, "http://x/1", a), (3, "http://x/2", a), (9, None, a), (4, "u\r\nv w", b), (4, "u", b),
            (None, "n", b), (7, "s", "short"), (8, "s", "short"), (10, "e", None), (11, "e", ""),
            (12, "big", big), (13, "big", big), (14, "é", "é" * 50), (15, "é", "é" * 49 + "e"),
            (None, "m", prose(5, 50)), (16, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    return [(*r, "x", "y") for r in rows]


def test_round_trip(spark):
    rows = pages()
    got = warc.archive_pages(frame(spark, rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want, first = [], {}
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        d = hashlib.sha256(p).hexdigest()
        if len(p) >= 100:
            old = first.get(d)
            first[d] = i if old is None else old if i is None else min(i, old)
        want.append((i, len(p), d))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=repr) == \
        sorted(want, key=repr)
    for d in {w[2] for w in want}:
        same = [r for r in got if r.payload_digest == d]
        if same[0].payload_bytes < 100:
            assert all(r.record_type == "response" and r.refers_to is None for r in same)
            continue
        response = [r for r in same if r.record_type == "response"]
        assert len(response) == 1 and response[0].page_id == first[d]
        assert response[0].refers_to is None
        assert all(r.refers_to == first[d] for r in same if r.record_type == "revisit")


def test_files_have_a_member_per_record(spark):
    root = scratch_path(spark, "warc-test")
    raw = warc.stage(warc.write_archives(frame(spark, pages(), SCHEMA).coalesce(1), root), "raw")
    new = warc.stage(warc.normalise(raw, warc.revisits(raw), root), "new")
    (r,), (n,) = raw.select("archive").distinct().collect(), new.collect()
    fs, _ = warc.open_fs(root)
    old = fs.open_input_stream(r.archive, compression=None).read()
    one = zlib.decompressobj(31)
    one.decompress(old)
    assert one.eof and not one.unused_data  # a single stream
    data = fs.open_input_stream(n.archive, compression=None).read()
    index = fs.open_input_stream(n["index"], compression=None).read().decode().splitlines()
    assert len(index) == n.records == raw.count() == len(pages())
    end = 0
    for line in index:
        at, size, kind, _, digest = line.split("\t")
        assert int(at) == end
        end += int(size)
        text = zlib.decompress(data[int(at):end], 31)
        assert text.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}\r\n".encode() in text
        assert f"sha256:{digest}".encode() in text
    assert end == len(data)


def test_empty_table(spark):
    assert warc.archive_pages(frame(spark, [], SCHEMA)).count() == 0


def test_reader_wants_whole_records():
    whole = warc.record([("WARC-Type", "response")], b"HTTP\r\n\r\nabc")
    for cut in (10, len(whole) - 1):
        with pytest.raises(ValueError):
            list(warc.records(iter([whole[:cut]])))
    two = zlib.compress(whole, wbits=31) * 2
    got = list(warc.records(warc.inflate(io.BytesIO(two))))
    assert [b for _, b in got] == [b"HTTP\r\n\r\nabc"] * 2
