"""Hierarchical packing of tokenised documents into windows of several context sizes.

Full stretches of the longest window stand alone.  What is left of each document is routed to the smallest tier that
holds it; each tier is packed longest first, and the gaps of long windows are filled from the shorter tiers, the last
filler being cut to fit.  Windows of one flush are then dealt into step groups of equal token load.

Everything happens inside the task that read the documents: ids are never shuffled, memory is bounded by one flush, and
a lost task is simply read again.  Only the last flush of a task can leave a window short.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are packed each; a null id is passed
through; an empty table gives an empty table; only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TIERS = (1024, 512, 256, 128)
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between blanks, where cutting before a space would change the pre-tokens.
UNSAFE = re.compile(r"\s (?:\s|$)")
CUT = re.compile(r"(?<=\S) (?=\S)")
CHUNK = 1 << 20

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary())]
)
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window int, step_group long, ids binary"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """token bytes -> id where the file is a byte-level BPE whose ids follow its merges, else None."""
    model = spec["model"]
    if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    for i, merge in enumerate(model["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        if vocab.get(left + right) != 256 + i:
            return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}


class Encoder(dict):
    """text -> little-endian unsigned 32-bit ids of a tokenizers file, without special tokens added.

    A byte-level pre-token never spans a space that stands between two texts' words, so words are encoded once and
    remembered (up to `limit` words: a cache, ids never depend on it).  Texts where that does not hold, and texts that
    hold an added token, are encoded whole."""

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.limit, self.slow = limit, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = merge_ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return pa.array(self.slow.encode(text, add_special_tokens=False).ids, pa.uint32()).buffers()[1].to_pybytes() if text else b""

    def __missing__(self, word: str) -> bytes:
        piece = " " + word
        # both libraries agree on letters up to Latin Extended-B; others go to the file's own library
        if max(piece) < "ɐ":
            ids = self.fast(piece)
        else:
            ids = self.slow.encode(piece, add_special_tokens=False).ids
        value = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) < self.limit and len(word) < 64:
            self[word] = value
        return value

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return self.whole(text)
        parts, at = [], 0
        while len(text) - at > CHUNK:
            cut = CUT.search(text, at + CHUNK)
            if cut is None:
                break
            parts.append(text[at : cut.start()])
            at = cut.start()
        parts.append(text[at:] if at else text)
        return b"".join(self.whole(p) if UNSAFE.search(p) else self.plain(p) for p in parts)


class Window:
    __slots__ = ("size", "free", "pieces")

    def __init__(self, size: int):
        self.size, self.free, self.pieces = size, size, []


def pack(rest: list[tuple[int, tuple]], tiers: tuple[int, ...], last: bool) -> tuple[list[Window], list[tuple[int, tuple]]]:
    """Windows from (length, piece) with lengths under the largest tier; piece is (document, start).

    Where not last, what fills no window is handed back for the next flush."""
    tiers = tuple(sorted(tiers, reverse=True))
    # one sorted stock per tier; an item is routed to the smallest tier that holds it
    stock: dict[int, list] = {t: [] for t in tiers}
    for n, piece in rest:
        stock[min(t for t in tiers if t >= n)].append((n, piece))
    for items in stock.values():
        items.sort(key=lambda x: x[0])

    def put(window: Window, n: int, piece: tuple) -> None:
        window.pieces.append((n, piece))
        window.free -= n

    def back(n: int, piece: tuple) -> None:
        insort(stock[min(t for t in tiers if t >= n)], (n, piece), key=lambda x: x[0])

    def filler(gap: int, below: tuple[int, ...]) -> tuple[int, tuple] | None:
        """The longest item of the tiers that fits the gap, else the shortest of them to be cut."""
        for t in below:
            at = bisect_right(stock[t], gap, key=lambda x: x[0]) - 1
            if at >= 0:
                return stock[t].pop(at)
        return next((stock[t].pop(0) for t in reversed(below) if stock[t]), None)

    done: list[Window] = []
    for level, size in enumerate(tiers):
        while stock[size] and (size == tiers[0] or sum(x[0] for x in stock[size]) >= size or any(stock[t] for t in tiers[level + 1 :])):
            window = Window(size)
            put(window, *stock[size].pop())
            while window.free:
                item = filler(window.free, tiers[level + 1 :]) or (stock[size].pop(0) if stock[size] else None)
                if item is None:
                    break
                n, (doc, start) = item
                take = min(n, window.free)
                put(window, take, (doc, start))
                if take < n:
                    back(n - take, (doc, start + take))
            if window.free:
                for n, piece in window.pieces:
                    back(n, piece)
                break
            done.append(window)
    left = [x for items in stock.values() for x in items]
    if not last:
        return done, left
    # the end of a task: exact windows of the shorter tiers, then one short window
    for size in (*tiers, 0):
        while left and (sum(x[0] for x in left) >= size or not size):
            window = Window(size or tiers[0])
            while left and window.free:
                n, (doc, start) = left.pop()
                take = min(n, window.free)
                put(window, take, (doc, start))
                if take < n:
                    left.append((n - take, (doc, start + take)))
            done.append(window)
    return done, []


def step_groups(windows: list[Window], group_tokens: int) -> list[int]:
    """A group number per window: longest first into the group with the fewest tokens, so that steps cost alike."""
    total = sum(w.size for w in windows)
    heap = [(0, g) for g in range(max(1, -(-total // group_tokens)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i].size):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + windows[i].size, g))
        out[i] = g
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 0, tiers: tuple[int, ...] = TIERS, flush_tokens: int = 1 << 20, group_tokens: int = 8192, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece (PIECES_DDL): where it stands in its document and in its sequence, and its ids.

    tokenizer is the path of a tokenizers file, or a function that finds it on the executor."""
    longest = max(tiers)
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer if isinstance(tokenizer, str) else tokenizer())
        end = end_id.to_bytes(4, "little")
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        docs_held: dict[int, tuple] = {}
        full: list[Window] = []
        rest: list[tuple[int, tuple]] = []
        held, next_doc, next_seq, next_group = 0, 0, base, base

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal full, rest, held, next_seq, next_group
            windows, left = pack(rest, tiers, last)
            windows = full + windows
            cols: list[list] = [[] for _ in PIECES]
            groups = step_groups(windows, group_tokens)
            for window, group in zip(windows, groups):
                offset = 0
                for n, (doc, start) in window.pieces:
                    ident, ids, cut = docs_held[doc]
                    for col, value in zip(cols, (ident, start, n, cut, next_seq, offset, window.size, next_group + group, ids[4 * start : 4 * (start + n)])):
                        col.append(value)
                    offset += n
                next_seq += 1
            next_group += max(groups, default=-1) + 1
            full, rest = [], left
            kept = {doc for _, (doc, _) in left}
            for doc in [d for d in docs_held if d not in kept]:
                del docs_held[doc]
            held = sum(n for n, _ in left)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECES.types)], schema=PIECES)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                docs_held[next_doc] = (ident, ids, n)
                for start in range(0, n - longest + 1, longest):
                    window = Window(longest)
                    window.pieces.append((longest, (next_doc, start)))
                    full.append(window)
                if tail := n % longest:
                    rest.append((tail, (next_doc, n - tail)))
                held, next_doc = held + n, next_doc + 1
                if held >= flush_tokens:
                    yield flush(False)
        yield flush(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, PIECES_DDL)
