"""WARC archives: writing, normalising and reading by offset.

``write_archives`` writes one WARC file per input partition as a single gzip
stream (a monolithic file, which can only be read from its start).
``normalise`` inflates every such stream once and writes each record again as
a gzip member of its own, with a sidecar index of offsets; records whose payload
another record already holds become revisits there.  ``read_archives`` opens
the new files at the offsets of the sidecar.

Files go to ``root``, a folder that all executors share (the session's
checkpoint folder by default).  A task writes under a name of its own, and only
the names in the committed tables are read, so a task that is run again or
lost half-way leaves nothing that counts.  Payloads never shuffle.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import lean, stage

LEVEL = 1
CHUNK = 1 << 20
LEAST_BYTES = 100
MAX_TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def open_fs(uri: str):
    """File system and path of a folder's address."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def records(source):
    """(fields, block) of each record of an inflated stream, one at a time.

    ``source`` yields bytes; only the record at hand is held.
    """
    buffer = bytearray()
    done = False

    def fill(n: int) -> bool:
        nonlocal done
        while len(buffer) < n and not done:
            part = next(source, None)
            if part is None:
                done = True
            else:
                buffer.extend(part)
        return len(buffer) >= n

    while True:
        at = buffer.find(b"\r\n\r\n")
        while at < 0:
            before = len(buffer)
            if not fill(before + 1):
                if before:
                    raise ValueError("the archive ends inside a record's head")
                return
            at = buffer.find(b"\r\n\r\n", max(0, before - 3))
        fields = parse_fields(bytes(buffer[:at]))
        size = int(fields["Content-Length"])
        if not fill(at + 4 + size + 4):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(buffer[at + 4:at + 4 + size])
        del buffer[:at + 4 + size + 4]


def inflate(stream):
    """Bytes of a gzip file of one or more members, in bounded pieces."""
    member = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = member.decompress(data, CHUNK)
            if out:
                yield out
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
            else:
                data = member.unconsumed_tail


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4:]


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _page_uri(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page_of(uri: str | None):
    page = uri[len("<urn:page:"):-1] if uri else "null"
    return None if page == "null" else int(page)


def write_archives(pages: DataFrame, root: str, date: str = DATE) -> DataFrame:
    """One monolithic archive per partition of ``pages`` (page_id, url, html);
    returns a row per record: archive, place (in the archive), page_id, bytes
    and digest of the payload."""
    names = ["archive", "place", "page_id", "bytes", "digest"]

    @lean
    def write(batches):
        out = stream = path = None
        place = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, folder = open_fs(root)
                path = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz"
                fs.create_dir(folder, recursive=True)
                stream = fs.open_output_stream(path, compression=None)
                out = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            ids = batch.column("page_id").to_pylist()
            sizes, digests = [], []
            first = place
            for page, url, html in zip(ids, batch.column("url").to_pylist(),
                                       batch.column("html").to_pylist(), strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                sizes.append(len(body))
                digests.append(hashlib.sha256(body).hexdigest())
                stream.write(out.compress(record(
                    [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:row:{place}>"),
                     ("WARC-Concurrent-To", _page_uri(page)), ("WARC-Date", date),
                     ("WARC-Target-URI", _clean(url or "urn:none")),
                     ("Content-Type", "application/http;msgtype=response")],
                    HTTP % len(body) + body)))
                place += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(ids)), pa.array(range(first, place), pa.int64()),
                 pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests)],
                names=names)
        if out is not None:
            stream.write(out.flush())
            stream.close()

    return (pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(write, "archive string, place long, page_id long, bytes long, digest string"))


def revisits(written: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(archive, place, refers_to) of the records whose payload, of at least
    ``least_bytes``, an earlier one holds: that with the smallest page_id (nulls
    last, then the first by archive and place)."""
    sums = written.where(F.col("bytes") >= least_bytes)
    first = (sums.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "place"))
        .alias("first"), F.count("*").alias("n")).where("n > 1"))
    return (sums.join(first, "digest")
            .where((F.col("archive") != F.col("first.archive"))
                   | (F.col("place") != F.col("first.place")))
            .select("archive", "place", F.col("first.page_id").alias("refers_to")))


def _spread(archives: DataFrame) -> DataFrame:
    """About a task per archive: the rows are few and small, the work is not."""
    return archives.repartition(min(MAX_TASKS, max(1, 2 * archives.count())), "archive")


def normalise(written: DataFrame, repeats: DataFrame, root: str) -> DataFrame:
    """Writes the archives again with a gzip member per record, and beside each
    an index with a line per record: offset, length, type, record id, digest.

    ``repeats``: the rows to become revisits.  Those of one archive (a file, so
    a bounded number) travel to its task.  Returns (archive, index, records).
    """
    per_file = repeats.groupBy("archive").agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.struct("refers_to")))).alias("again"))
    work = _spread(written.select("archive").distinct().join(per_file, "archive", "left"))

    @lean
    def run(batches):
        fs, folder = open_fs(root)
        for batch in batches:
            for archive, again in zip(batch.column("archive").to_pylist(),
                                      batch.column("again").to_pylist(), strict=True):
                again = dict(again or [])
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                n = at = 0
                with (fs.open_input_stream(archive, compression=None) as raw,
                      fs.open_output_stream(name, compression=None) as out,
                      fs.open_output_stream(name + ".idx", compression=None) as index):
                    for fields, block in records(inflate(raw)):
                        payload = payload_of(block)
                        digest = hashlib.sha256(payload).hexdigest()
                        place = int(fields["WARC-Record-ID"][len("<urn:row:"):-1])
                        kind, more = "response", []
                        if place in again:
                            kind = "revisit"
                            more = [("WARC-Profile", REVISIT),
                                    ("WARC-Refers-To", _page_uri(again[place]["refers_to"]))]
                            block = block[:len(block) - len(payload)]
                        head = [(k, kind if k == "WARC-Type" else v) for k, v in fields.items()
                                if k != "Content-Length"]
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        data = gz.compress(record(
                            [*head, ("WARC-Payload-Digest", f"sha256:{digest}"), *more], block))
                        data += gz.flush()
                        out.write(data)
                        index.write(f"{at}\t{len(data)}\t{kind}\t{place}\t{digest}\n".encode())
                        at += len(data)
                        n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([name + ".idx"]), pa.array([n], pa.int64())],
                    names=["archive", "index", "records"])

    return work.mapInArrow(run, "archive string, index string, records long")


READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string, archive string, offset long, length long")


def read_archives(archives: DataFrame, root: str, rows: int = 2_000) -> DataFrame:
    """A row per record, each read at its offset.  A revisit's payload is not in
    its record: its size is what its HTTP head says, its digest the WARC field."""
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in READ.split(", ")]

    @lean
    def run(batches):
        fs, _ = open_fs(root)
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(),
                                      batch.column("index").to_pylist(), strict=True):
                found: list[tuple] = []
                with (fs.open_input_file(archive) as data,
                      fs.open_input_stream(index, compression=None) as lines):
                    rest = b""
                    while part := lines.read(CHUNK):
                        *whole, rest = (rest + part).split(b"\n")
                        for line in whole:
                            at, size = map(int, line.split(b"\t")[:2])
                            data.seek(at)
                            raw = zlib.decompress(data.read(size), 31)
                            cut = raw.index(b"\r\n\r\n")
                            f = parse_fields(raw[:cut])
                            block = raw[cut + 4:cut + 4 + int(f["Content-Length"])]
                            if f["WARC-Type"] == "revisit":
                                n = int(re.search(rb"Content-Length: (\d+)", block)[1])
                                digest = f["WARC-Payload-Digest"].split(":")[1]
                            else:
                                payload = payload_of(block)
                                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            found.append((
                                _page_of(f["WARC-Concurrent-To"]), n, digest, f["WARC-Type"],
                                _page_of(f.get("WARC-Refers-To")), f["WARC-Target-URI"],
                                archive, at, size))
                        for k in range(0, len(found), rows):
                            yield _rows(found[k:k + rows], names, kinds)
                        found = []

    def _rows(part, names, kinds):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return _spread(archives).mapInArrow(run, READ)


def archive_pages(pages: DataFrame, root: str | None = None,
                  least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages to monolithic archives to normalised ones, and read back.

    Columns as ``READ``.  A null html is an empty payload; a null page_id is
    kept; payloads under ``least_bytes`` are responses, whatever they repeat.
    """
    root = root or scratch_path(pages.sparkSession, "warc")
    raw = stage(write_archives(pages, root), "archives")
    new = stage(normalise(raw, revisits(raw, least_bytes), root), "normalised")
    return read_archives(new, root)
