"""Token counts: pieces are counted once per distinct pre-token.

1. Distinct pre-tokens of all texts with their frequencies (map-side sums).
2. Number of pieces of each distinct pre-token, in batches: a table.
3. Per-document pre-token frequencies joined to that table and summed.  The
   most frequent pre-tokens (at most ``head`` of at most ``head_bytes`` bytes
   each, so at most head * (head_bytes + 8) bytes) are broadcast and joined
   while the text is read; the rest is joined by a shuffle.

No ids are kept anywhere; texts never shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ROWS, UID, lean, most_frequent, stage, texts, with_uid
from .tokens import default_path, n_pieces, parted, spaced, words_stay

HEAD = 200_000
HEAD_BYTES = 48
LIMIT = 1024


def _batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
        names=["piece", "freq"])


def _cut(pieces: Counter, parts: Counter, path: str) -> Counter:
    """Counted pre-tokens, and those of counted chunks."""
    for part, n in parts.items():
        for piece in spaced(part, path):
            pieces[piece] = pieces.get(piece, 0) + n
    return pieces


#: Taken from the tokens of a chunk with pre-tokens that are not in the table.
_MORE = 1 << 40


class _Known(dict):
    """Tokens of a chunk by the broadcast table, less ``_MORE`` if pre-tokens of it are
    not there: ``others`` has these.  Words that are not there are rare, and not kept."""

    def __init__(self, table: dict[str, int], path: str):
        super().__init__()
        self.table, self.path, self.others = table, path, {}
        self.words_stay = words_stay(path)

    def __missing__(self, part: str) -> int:
        if part.isalpha() and self.words_stay:
            n = self.table.get(" " + part)
            if n is None:
                return -_MORE
        else:
            n, others = self.of(spaced(part, self.path))
            if others:
                self.others[part] = others
                n -= _MORE
        self[part] = n
        return n

    def of(self, pieces: list[str]) -> tuple[int, list[str]]:
        """Tokens of the pre-tokens in the table, and the pre-tokens that are not."""
        n = list(map(self.table.get, pieces))
        if None not in n:
            return sum(n), []
        return (sum(k for k in n if k is not None),
                [p for p, k in zip(pieces, n, strict=True) if k is None])

    def count(self, text: str | None) -> tuple[int, Counter]:
        """Tokens of a text as far as the table knows, and its other pre-tokens."""
        pieces, parts = parted(text, self.path)
        total, others = self.of(pieces)
        n = list(map(self.__getitem__, parts))
        here = sum(n)
        if here < 0:
            for part in [p for p, k in zip(parts, n, strict=True) if k < 0]:
                here += _MORE
                others += self.others.get(part) or [" " + part]
        if len(self) >= CACHE_ROWS:
            self.clear()
            self.others.clear()
        return total + here, Counter(others)


def pretoken_frequencies(docs: DataFrame, path: str) -> DataFrame:
    """(piece, freq) over all texts."""
    @lean
    def count(batches):
        pieces, parts = Counter(), Counter()
        for batch in batches:
            for text in texts(batch):
                first, rest = parted(text, path)
                pieces.update(first)
                parts.update(rest)
                if len(pieces) + len(parts) > CACHE_ROWS:
                    yield _batch(_cut(pieces, parts, path))
                    pieces, parts = Counter(), Counter()
        yield _batch(_cut(pieces, parts, path))

    return (docs.select("text").mapInArrow(count, "piece string, freq long")
            .groupBy("piece").agg(F.sum("freq").alias("freq")))


def piece_table(frequencies: DataFrame, path: str) -> DataFrame:
    """(piece, freq, n) with the number of tokens of each distinct pre-token."""
    @lean
    def size(batches):
        for batch in batches:
            n = n_pieces(batch.column("piece").to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), batch.column("freq"), pa.array(n, pa.int64())],
                names=["piece", "freq", "n"])

    return frequencies.mapInArrow(size, "piece string, freq long, n long")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT,
                 head: int = HEAD, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens.  Repeated rows are kept,
    a null doc_id too; other columns are ignored.
    """
    path = path or default_path()
    pieces = stage(piece_table(pretoken_frequencies(docs, path), path), "pieces")
    frequent = most_frequent(pieces.where(F.octet_length("piece") <= head_bytes), "freq", head)
    known = docs.sparkSession.sparkContext.broadcast(
        dict(map(tuple, frequent.select("piece", "n").collect())))

    @lean
    def join(batches):
        table = _Known(known.value, path)
        for batch in batches:
            sums, sizes, rest, freqs = [], [], [], []
            for text in texts(batch):
                n, others = table.count(text)
                sums.append(n)
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                rest.append(list(others))
                freqs.append(list(others.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(UID), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.string())),
                 pa.array(freqs, pa.list_(pa.int64()))],
                names=[UID, "doc_id", "n_bytes", "head", "rest", "freqs"])

    rows = stage(
        with_uid(docs).select(UID, F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(join, f"{UID} long, doc_id long, n_bytes long, head long, "
                          "rest array<string>, freqs array<long>"), "rows")
    tail = (rows.select(UID, F.explode(F.arrays_zip("rest", "freqs")).alias("r"))
            .select(UID, F.col("r.rest").alias("piece"), F.col("r.freqs").alias("times"))
            .join(pieces.select("piece", "n"), "piece")
            .groupBy(UID).agg(F.sum(F.col("times") * F.col("n")).alias("tail")))
    total = F.col("head") + F.coalesce("tail", F.lit(0))
    return (rows.select(UID, "doc_id", "n_bytes", "head").join(tail, UID, "left")
            .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")))
