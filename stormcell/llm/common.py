"""Shared pieces of the corpus operators: tables, row ids, words and shingles.

A word is a maximal run of letters and digits of the lower-cased text.  A
shingle is a 64-bit hash of five consecutive words; a text of one to four words
has a single shingle made of all of them, a text without words has none.
"""

from __future__ import annotations

import ctypes
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SHINGLE_WORDS = 5
SIMILARITY = 0.8
UID = "_uid"

#: Letters up to U+024F; texts with other non-ASCII characters take the slower exact path.
LATIN = "".join(chr(i) for i in range(0x80, 0x250) if unicodedata.category(chr(i))[0] == "L")
_NOT_LATIN = re.compile(f"[^\x00-\x7f{re.escape(LATIN)}]")
_WORD = re.compile(r"[^\W_]+")
_TO_SPACE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
CACHE_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (``--py-files`` does it elsewhere)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back (cuts the lineage); its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _release()  # of the driver's Python: what training or a broadcast has left
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    return staged(df, name)[0]


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a staged table that nothing will read any more."""
    if path is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_uid(df: DataFrame) -> DataFrame:
    """``df`` with a unique row id.  ``df`` has to be read from files (or be a
    local table): its rows then come in the same order whenever it is read, so
    that a lost task gives the same ids again."""
    return df.withColumn(UID, F.monotonically_increasing_id())


def packed(docs: DataFrame) -> DataFrame:
    """(_uid, _row): the ids that ``with_uid`` gives, and all columns in a struct, so
    that no name of theirs can clash."""
    return with_uid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))


def _spaced(text: str | None) -> bytes:
    """The words of a text, with spaces between them."""
    if not text:
        return b""
    text = text.lower()
    if text.isascii() or not _NOT_LATIN.search(text):
        return text.encode().translate(_TO_SPACE)
    return " ".join(_WORD.findall(text)).encode("utf-8", "surrogatepass")


def most_frequent(df: DataFrame, count: str, limit: int, kind: str | None = None) -> DataFrame:
    """The rows of ``df`` with the largest ``count``, at most ``limit`` (for each
    value of the integer column ``kind``).

    The cut is found in a histogram of the counts' sizes (eighths of a power of
    two), so nothing is sorted and no task gathers candidates; counts of the
    size at which the limit would be passed are left out together."""
    size = F.floor(F.log2(F.col(count)) * 8).cast("int")
    group = F.lit(0) if kind is None else F.col(kind)
    found = df.groupBy(group.alias("_kind"), size.alias("_size")).agg(F.count("*").alias("_n")).collect()
    keep = F.lit(False)
    for k in {r["_kind"] for r in found}:
        total, least = 0, None
        for s, n in sorted(((r["_size"], r["_n"]) for r in found if r["_kind"] == k), reverse=True):
            total += n
            if total > limit:
                break
            least = s
        if least is not None:
            keep = keep | ((group == k) & (size >= least))
    return df.where(keep)


def words(text: str | None) -> list[bytes]:
    return _spaced(text).split()


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    x = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)
    return mix(x * _ODD[0]) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_POWERS = {}  # of the base, and of its inverse, for as many bytes as were needed
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[1])
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(max(n, 1 << 16), x, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _hash_words(spaced: bytes) -> np.ndarray:
    """64-bit hash of each word: a polynomial of its bytes, from prefix sums."""
    b = np.frombuffer(b" " + spaced + b" ", np.uint8)
    space = b == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(b))
    prefix = np.cumsum(_BYTES[b] * up[:len(b)], dtype=np.uint64)
    h = (prefix[end - 1] - prefix[start - 1]) * down[start]
    return mix(h + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    spaced = _spaced(text)
    if len(spaced) <= CHUNK:
        return _hash_words(spaced)
    out, at = [], 0
    while at < len(spaced):  # cut at spaces only
        to = spaced.find(b" ", at + CHUNK)
        to = len(spaced) if to < 0 else to
        out.append(_hash_words(spaced[at:to]))
        at = to
    return np.concatenate(out)


def shingle_list(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Shingle hashes in text order, repeats included."""
    return word_shingles(word_hashes(text), n)


def word_shingles(h: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of ``n`` consecutive words, from those of the words."""
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < n:
        odd = odd_numbers(len(h), 77)
        return mix((h * odd).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    odd = odd_numbers(n, 5)
    out = h[: len(h) - n + 1] * odd[0]
    for i in range(1, n):
        out += h[i: len(h) - n + 1 + i] * odd[i]
    return mix(out)


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_list(text, n))


def texts(batch: pa.RecordBatch, rows: int = 500):
    """The batch's texts as strings, a few at a time."""
    column = batch.column("text")
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def _release() -> None:
    """Give freed memory back: workers live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A task over Arrow batches that gives its memory back when it ends."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            _release()
    return task


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list column from one array per row."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def runs(batches, key: list[str]):
    """Group rows that come sorted by ``key``: yields one table per key.

    Only one group is held at a time, plus a batch.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = list(zip(*(t.column(c).to_pylist() for c in key), strict=True))
        starts = [0] + [i for i in range(1, len(k)) if k[i] != k[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(k)], strict=True):
            if held and k[a] != last:
                yield last, pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(a, b - a))
            last = k[a]
    if held:
        yield last, pa.concat_tables(held).combine_chunks()
