"""Coded streams kept text by text: a byte a symbol, and the symbols just before each text beside it.

A row a symbol costs its position and its keys at every shuffle.  Here only the codes move, once; rows are made where they
are counted.  Texts are cut in numpy over whole Arrow batches, and no pass shuffles or stores a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ngram
from ..operators.lags import with_lags
from ..operators.ranks import sum_before
from ..operators.split import strided
from .shared import stored

#: Symbols kept before each text: farther lags go over rows.  Bytes and rows that a task handles at a time, and positions
#: per group of texts that look for the symbols before them.
MARGIN, PIECE, ROWS, CHUNK = 64, 1 << 20, 1 << 18, 1 << 20

SPACE, LETTER, DIGIT, OTHER, INSIDE = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[128:192] = INSIDE


@dataclass
class Symbols:
    """Texts and the granularity they are cut at, byte or word."""

    texts: DataFrame
    id_col: str
    text_col: str
    gran: str

    def __post_init__(self):
        if self.gran not in ("byte", "word"):
            raise ValueError(f"unknown granularity {self.gran}")

    def named(self) -> DataFrame:
        return self.texts.select(F.col(self.id_col).alias("id"), F.col(self.text_col).cast("string").cast("binary").alias("text")).where("id is not null")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary column; null counts as empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(batches: Iterator[pa.RecordBatch], by: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about PIECE bytes of a binary column."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(by)), 0)).astype(np.int64)
        run = (np.cumsum(lengths) - lengths) // PIECE
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def cut(text: pa.Array, gran: str, with_words: bool = True) -> tuple[pa.Array | np.ndarray | None, np.ndarray]:
    """(all symbols of a column of texts, the place of each text's first one and the end): bytes, or the words that
    tokens.WORD matches: runs of letters, runs of digits, single other characters."""
    data, offsets = flat(text)
    if gran == "byte":
        return data, offsets
    kind = KINDS[data]
    first = kind != np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
    first |= kind == OTHER
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    first &= (kind != SPACE) & (kind != INSIDE)
    starts = np.flatnonzero(first)
    places = np.searchsorted(starts, offsets)
    if not with_words:
        return None, places
    kept = kind != SPACE
    ends = np.cumsum(kept, dtype=np.int32)
    at = np.append(ends[starts] - 1, ends[-1] if len(ends) else 0)
    return binary(data[kept], at), places


def sizes(s: Symbols) -> DataFrame:
    """(id, n): symbols per text."""
    named, gran = s.named(), s.gran
    if gran == "byte":
        return named.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(cut(part.column("text"), gran, False)[1]).astype(np.int64))], names=["id", "n"])

    return named.mapInArrow(task, f"id {named.schema['id'].dataType.simpleString()}, n long")


def vocabulary(s: Symbols, size: int, last_id, most: int) -> list:
    """The size-1 most frequent symbols of the texts up to last_id, of which the first `most` symbols count; ties go to
    the smaller byte, or to the word seen first."""
    named, gran = s.named(), s.gran
    side = named.where(F.col("id") <= F.lit(last_id)).withColumn("most", F.when(F.col("id") == F.lit(last_id), F.lit(most)).cast("long"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            part = part.take(pc.sort_indices(part.column("id")))  # words come by id and place: a dictionary is by first appearance
            symbols, places = cut(part.column("text"), gran)
            place = np.arange(places[-1]) - np.repeat(places[:-1], np.diff(places))
            if part.column("most").null_count < part.num_rows:
                limits = np.asarray(part.column("most").fill_null(np.iinfo(np.int64).max))
                inside = place < np.repeat(limits, np.diff(places))
            else:
                inside = np.ones(len(place), bool)
            coded = pa.array(symbols).dictionary_encode() if gran == "byte" else symbols.dictionary_encode()
            which = np.asarray(coded.indices)
            found = np.flatnonzero(inside)
            codes, first, n = np.unique(which[found], return_index=True, return_counts=True)
            at = found[first]
            text = np.searchsorted(places, at, side="right") - 1
            values = coded.dictionary.take(pa.array(codes))
            raw = pa.array([bytes([v]) for v in values.to_pylist()], pa.binary()) if gran == "byte" else values
            yield pa.RecordBatch.from_arrays([raw, pa.array(n.astype(np.int64)), part.column("id").take(pa.array(text)), pa.array(place[at].astype(np.int64))], names=["raw", "n", "id", "pos"])

    counts = side.mapInArrow(task, f"raw binary, n long, id {named.schema['id'].dataType.simpleString()}, pos long")
    order = F.col("raw") if gran == "byte" else F.col("first")
    top = counts.groupBy("raw").agg(F.sum("n").alias("n"), F.min(F.struct("id", "pos")).alias("first")).orderBy(F.desc("n"), order).limit(size - 1)
    return [bytes(r["raw"]) for r in top.collect()]


def coded(s: Symbols, words: list, kind: str, last: int | None = None) -> DataFrame:
    """(id, codes) of the texts with symbols: 0 outside the vocabulary, else 1 on; or the last so many codes only."""
    named, gran, width = s.named(), s.gran, np.dtype(kind).itemsize

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, kind)
        for code, word in enumerate(words if gran == "byte" else (), 1):
            table[word[0]] = code
        known = pa.array(words, pa.binary())
        for part in pieces(batches):
            symbols, places = cut(part.column("text"), gran)
            codes = table[symbols] if gran == "byte" else (np.asarray(pc.fill_null(pc.index_in(symbols, value_set=known), -1)) + 1).astype(kind)
            whole = binary(codes.view(np.uint8), places * width)
            some = pa.array(np.diff(places) > 0)
            out = whole if last is None else pc.binary_slice(whole, -last * width)
            yield pa.RecordBatch.from_arrays([part.column("id").filter(some), out.filter(some)], names=["id", "codes"])

    return named.mapInArrow(task, f"id {named.schema['id'].dataType.simpleString()}, codes binary")


def befores(tails: DataFrame, width: int) -> DataFrame:
    """(id, before, left) from (id, before, n, codes): the last MARGIN symbols of the stream before each text.

    Texts meet in groups by position; one is also a member of the groups in which texts start that need its end."""
    end = F.col("before") + F.col("n")
    home = F.floor(F.col("before") / CHUNK)
    homes = F.array_union(F.array(home), F.sequence(F.floor(end / CHUNK), F.floor((end + MARGIN - 1) / CHUNK)))
    spread = tails.select("id", "before", "codes", home.alias("home"), F.explode(homes).alias("chunk"))

    def task(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("before", "ascending")]))
        so_far, lefts = b"", []
        for codes in group.column("codes").to_pylist():
            lefts.append(so_far)
            so_far = (so_far + codes)[-MARGIN * width :]
        own = pc.equal(group.column("home"), group.column("chunk"))
        return pa.table({"id": group.column("id"), "before": group.column("before"), "left": pa.array(lefts, pa.binary())}).filter(own)

    return spread.groupBy("chunk").applyInArrow(task, f"id {tails.schema['id'].dataType.simpleString()}, before long, left binary")


@dataclass
class Packed:
    """(before, left, codes) per text with symbols: its place in the stream, the MARGIN symbols there before it (fewer at
    the beginning of the stream) and its own, as numbers of the numpy type `kind`."""

    texts: DataFrame
    kind: str

    def rows(self, columns: dict[str, int], start: int = 0, stride: int = 1, t_back: int = 0) -> DataFrame:
        """(t, *columns) for every stride-th position u from start on: column c is the symbol at u - columns[c], null before
        the beginning, and t is u - t_back."""
        kind = self.kind
        width = np.dtype(kind).itemsize

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "codes"):
                data, offsets = flat(pc.binary_join_element_wise(part.column("left"), part.column("codes"), b""))
                symbols, before = data.view(kind), np.asarray(part.column("before"))
                own = np.asarray(pc.binary_length(part.column("codes"))).astype(np.int64) // width
                base = offsets[1:] // width - own
                first = start + -(-np.maximum(before - start, 0) // stride) * stride
                ends = np.cumsum(np.maximum(0, -(-(before + own - first) // stride)))
                for a in range(0, int(ends[-1]), ROWS):
                    row = np.arange(a, min(a + ROWS, int(ends[-1])))
                    text = np.searchsorted(ends, row, side="right")
                    u = first[text] + (row - np.where(text > 0, ends[text - 1], 0)) * stride
                    at = base[text] + u - before[text]
                    least = int(u.min())
                    made = [pa.array(symbols[np.maximum(at - j, 0)].astype(np.int32), mask=u < j if least < j else None) for j in columns.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(u - t_back), *made], names=["t", *columns])

        return self.texts.mapInArrow(task, ", ".join(["t long", *[f"{c} int" for c in columns]]))

    def stream(self) -> DataFrame:
        """(t, x), a row a symbol."""
        return self.rows({"x": 0})


def strided_lags(stream: DataFrame | Packed, lags: list[int], start: int, stride: int) -> DataFrame:
    """(t, x0, x1, ...): the lagged symbols at every stride-th position from start on."""
    if isinstance(stream, Packed) and max(lags, default=0) <= MARGIN:
        return stream.rows({f"x{j}": j for j in lags}, start, stride)
    rows = stream.stream() if isinstance(stream, Packed) else stream
    return with_lags(rows, lags).where(strided(F.col("t"), start, stride))


def contexts(stream: DataFrame | Packed, order: int, lag: int) -> DataFrame:
    """(t, x0..x{order-2}, y): the context of each position and the symbol `lag` ahead of it."""
    back = list(range(max(order - 1, 1)))
    if isinstance(stream, Packed) and lag + back[-1] <= MARGIN:
        return stream.rows({f"x{i}": lag + i for i in back} | {"y": 0}, lag, t_back=lag)
    rows = stream.stream() if isinstance(stream, Packed) else stream
    return ngram.contexts(rows, order, lag)


def packed(s: Symbols, k: int, train: tuple[int, int] = (7, 8)) -> tuple[Packed, int, int]:
    """(stream, its length, the end of its training side) with a vocabulary of k from the training side, 0 for the rest."""
    placed = sum_before(stored(sizes(s), "sizes"), ["id"], "n").where("n > 0").select("id", "before", F.col("n").cast("long").alias("n"))
    n = placed.agg(F.sum("n")).first()[0] or 0
    end = train[0] * n // train[1]
    words, kind = [], "u1" if k <= 256 else "<i4"
    if end:
        last = placed.where((F.col("before") < end) & (F.col("before") + F.col("n") >= end)).first()
        words = vocabulary(s, k, last["id"], end - last["before"])
    lefts = befores(placed.join(coded(s, words, kind, MARGIN), "id"), np.dtype(kind).itemsize)
    texts = coded(s, words, kind).join(lefts, "id").select("before", "left", "codes")
    return Packed(stored(texts, "packed"), kind), n, end
