"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets.

Items are partitioned by the size of their shingle set (powers of two).  For every size class in use, a document's
shingles are cut into stretches of that size and each stretch gets a one-permutation MinHash sketch (one minimum for
each of 2**BIN_BITS bins), so that a short item meets stretches of its own size however long the document is.  A stretch
that shares a bin minimum with an item makes a candidate; candidates are verified by the exact share of the item's
shingles that the whole document holds.

Items of up to WHOLE shingles form the class of stretches of one: every shingle is its own minimum, so an item is a candidate
wherever one of its shingles stands and none is lost.  From there on an item that stands together is lost with a
probability that falls with its size (under 1e-7 from nine shingles on); the shingles of a long item that are scattered
one by one over a long document may be missed.

Documents are never shuffled.  The benchmark travels to the tasks in blocks of bounded size; a benchmark over one block
takes one pass over the documents per block, each block's result being stored before the next is read.

Defined cases: null and empty texts hold nothing; an item without words is never found; an item shorter than a shingle
is one shingle, found only in documents that are equally short; repeated rows are judged each; empty tables give empty
results; extra columns of documents are passed through by drop_contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .words import WordHashes, shingles

BIN_BITS = 6
#: Items of so many shingles or fewer are looked up by every shingle.
WHOLE = 8
#: Bounds of a benchmark block: items, and shingles in all of them (8 bytes each, twice).
BLOCK_ITEMS, BLOCK_SHINGLES = 50_000, 2_000_000
KEEP_BITS = np.uint64(18)
VALUE_BITS = np.uint64(64 - 18)
GROUP_SHIFT = np.uint64(64 - 18 - BIN_BITS)

PAIRS_DDL = "doc_id long, item_id long, shared int, item_shingles int, containment double"
PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int32()), ("item_shingles", pa.int32()), ("containment", pa.float64())])


def bin_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest values of each bin of each stretch of `size` shingles, cut to 46 bits (bin first), sorted and distinct.

    The bin is the top of a value, so a minimum needs no bin beside it; in stretches of one all values are minima."""
    if size == 1:
        return np.unique(values >> KEEP_BITS)
    found = []
    step = size << 16
    for at in range(0, len(values), step):
        part = values[at : at + step]
        block = np.arange(len(part), dtype=np.uint64) // np.uint64(size)
        keyed = np.sort((block << VALUE_BITS) | (part >> KEEP_BITS))
        group = keyed >> GROUP_SHIFT
        first = np.ones(len(keyed), bool)
        first[1:] = group[1:] != group[:-1]
        found.append(keyed[first] & ((np.uint64(1) << VALUE_BITS) - np.uint64(1)))
    return np.unique(np.concatenate(found)) if found else values


class Index:
    """A benchmark block: shingle sets, and per size class the sorted bin minima with the items that own them."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        classes: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, s) in enumerate(items):
            if len(s):
                size = 1 if len(s) <= WHOLE else 1 << (len(s) - 1).bit_length()
                classes.setdefault(size, []).append((bin_minima(s, 1 if size == 1 else len(s)), k))
        self.classes = []
        for size, owned in sorted(classes.items()):
            values = np.concatenate([v for v, _ in owned])
            owner = np.concatenate([np.full(len(v), k, np.int64) for v, k in owned])
            order = np.argsort(values, kind="stable")
            self.classes.append((size, values[order], owner[order]))

    def candidates(self, sequence: np.ndarray) -> np.ndarray:
        found = []
        for size, values, owner in self.classes:
            minima = bin_minima(sequence, size)
            at = np.searchsorted(minima, values)
            at[at == len(minima)] = 0
            found.append(owner[minima[at] == values])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, sequence: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
        """(item, shared shingles, item shingles) with 100 * shared >= percent * item shingles."""
        if not len(sequence):
            return []
        likely = self.candidates(sequence)
        if not len(likely):
            return []
        own = np.unique(sequence)
        out = []
        for k in likely:
            wanted = self.sets[k]
            at = np.searchsorted(own, wanted)
            at[at == len(own)] = 0
            shared = int((own[at] == wanted).sum())
            if 100 * shared >= percent * len(wanted):
                out.append((int(k), shared, len(wanted)))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one at a time; rows stream through the driver."""
    hashes = WordHashes()
    items, total = [], 0
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).distinct()
    for row in rows.toLocalIterator():
        s = np.unique(shingles(hashes.of(bytes(row["t"] or b"")), words))
        if items and (len(items) >= BLOCK_ITEMS or total + len(s) > BLOCK_SHINGLES):
            yield Index(items)
            items, total = [], 0
        items.append((row["i"], s))
        total += len(s)
    if items:
        yield Index(items)


def find_items(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every item held by a document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    spark = docs.sparkSession

    def one_pass(held) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, index = WordHashes(), held.value
            for batch in batches:
                rows = []
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for k, shared, size in index.matches(shingles(hashes.of(text.as_py() or b""), words), percent):
                        rows.append((ident, index.ids[k], shared, size, shared / size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PAIRS.types)], schema=PAIRS)

        return texts.mapInArrow(task, PAIRS_DDL)

    out, previous = None, None
    for index in blocks(benchmark, item_id, item_text, words):
        if previous is not None:
            done = stored(one_pass(previous), "contaminated")
            out = done if out is None else out.unionByName(done)
            previous.destroy()
        previous = spark.sparkContext.broadcast(index)
    if previous is None:
        return spark.createDataFrame([], PAIRS_DDL)
    last = one_pass(previous)
    return last if out is None else out.unionByName(last)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; rows are filtered where they are read, all columns pass through.

    Null and empty texts hold nothing and stay; rows that repeat an id or a text are judged each; no column name is used
    but text_col's; an empty benchmark or table drops nothing."""
    spark, schema = docs.sparkSession, docs.schema
    column = docs.columns.index(text_col)
    out, held, before = docs, None, None
    for index in blocks(benchmark, item_id, item_text, words):
        if held is not None:
            out, old = stored(out, "clean"), before
            held.destroy()
            if old is not None:
                discard(old)
            before = out
        held = spark.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            hashes, index = WordHashes(), held.value
            for batch in batches:
                keep = [not index.matches(shingles(hashes.of((t.as_py() or "").encode()), words), percent) for t in batch.column(column)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(task, schema)
    return out
