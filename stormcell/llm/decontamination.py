"""Benchmark decontamination: size-partitioned MinHash containment search.

Short items are looked for inside long documents.  Items are partitioned by
the size of their shingle set, a class holding sizes in (S/2, S].  For a class,
a document is read as overlapping windows of 2 S shingles, one every S, so
that a passage of S shingles lies whole in one of them.  The size bounds turn a
containment of t into a Jaccard similarity of at least t q / (q + 2 S - t q),
for t = 0.8 between 0.19 and 0.36, whatever the document's length.  A window
and an item are candidates when one of ``hashes`` min-hashes agrees: 40 of them
miss a passage at 0.19 twice in 10,000 times, at 0.36 once in 10^7.  The
min-hashes of all window sizes come from the same block minima.  Every candidate is then
verified: the share of the item's distinct shingles that occur anywhere in the
document, counted exactly.

An item of one to four words has one shingle, of all its words.  Its class is its
number of words: the document's n-grams of that length are looked up, which is
exact, so a short item is found inside a long document too.

Items go to the tasks in blocks of at most ``block_items`` and ``block_bytes``
(a longer item is a block alone), so what is broadcast is bounded by parameters
and a larger benchmark means more passes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (SHINGLE_WORDS, SIMILARITY, UID, lean, odd_numbers, packed, texts, word_hashes,
                     word_shingles)

HASHES = 40
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 << 20
PART = 1 << 18


def size_class(n: int) -> int:
    """Class c holds the sizes in (2^c, 2^(c + 1)], class 0 also size 1; its
    windows are two blocks of 2^(c + 1) shingles."""
    return max(0, (n - 1).bit_length() - 1)


def _bits(value: np.ndarray) -> np.ndarray:
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(12)


class ItemIndex:
    """Min-hashes and shingles of one block of items, by size class."""

    def __init__(self, items: list[tuple[int, str]], hashes: int):
        self.odd = odd_numbers(hashes, 41).astype(np.uint32)
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        keys: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, text in items:
            h = word_hashes(text)
            if not len(h):
                continue
            if len(h) < SHINGLE_WORDS:
                s = word_shingles(h, len(h))
                self.short[len(h)][int(s[0])].append(len(self.ids))
                self.ids.append(item)
                self.sets.append(s)
                continue
            s = np.unique(word_shingles(h))
            low = (s.astype(np.uint32)[:, None] * self.odd).min(axis=0)
            keys[size_class(len(s))] += [(int(v), h, len(self.ids)) for h, v in enumerate(low)]
            self.ids.append(item)
            self.sets.append(s)
        self.grams = {n: np.array(sorted(found), np.uint64) for n, found in self.short.items()}
        self.classes = {}
        for c, rows in keys.items():
            rows.sort()
            value, which, item = (np.array([r[k] for r in rows], t) for k, t in
                                  ((0, np.uint32), (1, np.int64), (2, np.int64)))
            known = np.zeros(2**20, bool)  # most values are told apart by 20 bits
            known[_bits(value)] = True
            self.classes[c] = known, value, which, item

    def few_words(self, h: np.ndarray) -> set[int]:
        """Items of one to four words that follow one another among the words ``h``."""
        out: set[int] = set()
        for n, grams in self.grams.items():
            if len(h) >= n:
                for g in np.intersect1d(word_shingles(h, n), grams):
                    out.update(self.short[n][int(g)])
        return out

    def candidates(self, sequence: np.ndarray) -> set[int]:
        """Items with a min-hash of one of the sequence's windows.

        Very long sequences are read in parts that overlap by the largest window."""
        if not len(sequence) or not self.classes:
            return set()
        overlap = 2 * 2**(max(self.classes) + 1)
        step = max(PART, 2 * overlap)
        return set().union(*(self._windows(sequence[i:i + step + overlap])
                             for i in range(0, len(sequence), step)))

    def _windows(self, sequence: np.ndarray) -> set[int]:
        found: set[int] = set()
        first = min(self.classes)
        size = 2**(first + 1)
        half = sequence.astype(np.uint32)
        if len(half) % size:  # repeating a shingle changes no minimum
            half = np.concatenate([half, np.repeat(half[-1:], size - len(half) % size)])
        step = max(size, 2048)
        low = np.concatenate([
            (half[i:i + step, None] * self.odd).reshape(-1, size, len(self.odd)).min(axis=1)
            for i in range(0, len(half), step)])
        for c in range(first, max(self.classes) + 1):
            if c > first:  # blocks of twice the length
                if len(low) % 2:
                    low = np.concatenate([low, low[-1:]])
                low = np.minimum(low[::2], low[1::2])
            if c not in self.classes:
                continue
            known, value, which, item = self.classes[c]
            flat = (np.minimum(low[:-1], low[1:]) if len(low) > 1 else low).ravel()
            hit = np.nonzero(known[_bits(flat)])[0]
            at = np.searchsorted(value, flat[hit])
            sure = value[np.minimum(at, len(value) - 1)] == flat[hit]
            for f, k in zip((hit[sure] % len(self.odd)).tolist(), at[sure].tolist(), strict=True):
                v = value[k]
                while k < len(value) and value[k] == v:
                    if which[k] == f:
                        found.add(int(item[k]))
                    k += 1
        return found


def contained(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY,
              hashes: int = HASHES, block_items: int = BLOCK_ITEMS,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every row of
    ``docs`` and of ``items`` of which at least ``similarity`` of the item's
    shingles are in the document.

    Null or empty texts match nothing, nor do items without a word; an item of
    one to four words matches every document that has just these words in a row
    (so does an everyday word, if it is an item).  Repeated rows give repeated
    results; other columns are ignored; empty tables give none.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, shared int, item_shingles int, containment double"
    out = spark.createDataFrame([], schema)
    block: list[tuple[int, str]] = []
    held_bytes = 0

    def search(held):
        @lean
        def run(batches):
            index = ItemIndex(held.value, hashes)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(),
                                     texts(batch), strict=True):
                    h = word_hashes(text)
                    sequence = word_shingles(h)
                    rows += [(doc, index.ids[k], 1, 1, 1.0) for k in sorted(index.few_words(h))]
                    found = index.candidates(sequence)
                    if not found:
                        continue
                    whole = np.unique(sequence)
                    for k in sorted(found):
                        s = index.sets[k]
                        at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
                        n = int((whole[at] == s).sum())
                        if n >= similarity * len(s) - 1e-9:
                            rows.append((doc, index.ids[k], n, len(s), n / len(s)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (
                            pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()),
                            strict=True)],
                        names=["doc_id", "item_id", "shared", "item_shingles", "containment"])
        return slim.mapInArrow(run, schema)

    for item, text, size in items.select(F.col("item_id").cast("long"), "text", F.coalesce(
            F.octet_length("text"), F.lit(0))).toLocalIterator():
        if block and (len(block) == block_items or held_bytes + size > block_bytes):
            out = out.union(search(spark.sparkContext.broadcast(block)))
            block, held_bytes = [], 0
        block.append((item, text))
        held_bytes += size
    if block:
        out = out.union(search(spark.sparkContext.broadcast(block)))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the rows that contain an item.

    Rows with a null or empty text stay, as do all rows under an empty ``items``."""
    rows = packed(docs)
    leaks = contained(rows.select(F.col(UID).alias("doc_id"), F.col("_row.text").alias("text")),
                      items, **options)
    gone = leaks.select(F.col("doc_id").alias(UID)).distinct()
    return rows.join(gone, UID, "left_anti").select("_row.*")
