"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes.

Fit (bounded): at most EXAMPLES_TOXIC and EXAMPLES_CLEAN labelled rows, first by hash of their id, weighted by the labelled
rows that they stand for.  Terms are words and word prefixes held by LEAST_SHARE to MOST_SHARE of the labelled rows and
by LEAST_SUPPORT examples; the label takes no part in their choice.  Inverse document frequencies are counted over all
documents.  The cosine is taken in a diagonal metric learned from the examples: a term's weight is its TF-IDF times
min(1, |z| / FULL_Z), FLOOR at least, where z is its association with the label, of either sign.  So every text with
ordinary words has neighbours, and terms that tell the labels apart count for more.  Votes of the nearest examples,
weighted by closeness and by how many labelled rows an example stands for, are calibrated by isotonic regression on
leave-one-out votes.

PREFIXES, LEAST_SHARE, MOST_SHARE, FLOOR, FULL_Z and NEIGHBOURS were chosen by three-fold cross-validation inside rows that are not
held out (README has the figures).

Score: every whole text is a query.  Examples stand in blocks with the largest weight of each term; blocks are opened in
the order of their score bound until the bound falls under the k-th best cosine, so the neighbours are exact.

Defined cases: null and empty texts and texts without a kept term get the calibrated rate of such texts; a null label
or id teaches nothing; a document labelled twice takes its larger label; without labels every score is 0.1; repeated rows
are scored each; equal cosines go to the example of the smaller id; an empty table gives an empty table;
columns of the input other than id and text are not read by score_documents and passed through by drop_toxic, where a
null id does no harm because no id is read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored

EXAMPLES_TOXIC, EXAMPLES_CLEAN, NEIGHBOURS, BLOCK = 1000, 2000, 15, 64
LEAST_SHARE, MOST_SHARE, LEAST_SUPPORT = 0.005, 0.1, 5
FLOOR, FULL_Z = 0.1, 8.0
PREFIXES = (4,)
#: Letters and digits of ASCII in lower case and all bytes of other characters make words; all else separates.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))

EVIDENCE = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(EVIDENCE))])
SCORES_DDL = "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word itself, and its prefixes marked by a trailing star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


class TermCounts(dict):
    """word -> indices of the kept terms it holds; remembers up to a limit, which bounds memory and changes nothing."""

    def __init__(self, terms: dict[bytes, int], limit: int = 300_000):
        super().__init__()
        self.limit = limit
        self.words = {t: i for t, i in terms.items() if not t.endswith(b"*")}
        self.starts = [(n, {t[:-1]: i for t, i in terms.items() if t.endswith(b"*") and len(t) == n + 1}) for n in PREFIXES]

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = [self.words.get(word), *(held.get(word[:n]) for n, held in self.starts if len(word) >= n)]
        value = tuple(i for i in found if i is not None)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(term indices in order, how often each is held)."""
        found = np.fromiter(chain.from_iterable(map(self.__getitem__, words_of(text))), np.int32)
        return np.unique(found, return_counts=True)


def vector(at: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term indices, weights) of unit length, tf damped by a logarithm; empty where no term with a scale is held."""
    w = (1 + np.log(counts)) * scale[at]
    norm = math.sqrt(float(w @ w))
    return (at, w / norm) if norm else (at[:0], w[:0])


def clusters(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, count: int = 16, rounds: int = 6) -> list[int]:
    """A cluster per example by a few rounds of spherical k-means: examples of one kind, as of one language, share blocks of
    the index, whose bounds are tighter then.  Only speed depends on it."""
    first = vectors[:: max(1, len(vectors) // count)][:count]
    centres = np.zeros((len(first), terms))
    for c, (at, w) in enumerate(first):
        centres[c, at] = w
    for _ in range(rounds):
        kind = [int((centres[:, at] @ w).argmax()) for at, w in vectors]
        centres = np.zeros_like(centres)
        for c, (at, w) in zip(kind, vectors):
            centres[c, at] += w
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return kind


class BlockMaxIndex:
    """Examples in blocks of BLOCK; per term and block the largest weight, and postings sorted by block, then term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, ids: np.ndarray | None = None):
        """ids break ties, the smaller first; without them the place in the index does."""
        self.count, self.terms = len(vectors), terms
        self.ids = np.arange(self.count) if ids is None else ids
        self.blocks = -(-self.count // BLOCK)
        sizes = [len(at) for at, _ in vectors]
        who = np.repeat(np.arange(self.count), sizes)
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        cell = who // BLOCK * terms + term
        order = np.argsort(cell, kind="stable")
        self.who, self.weight = who[order].astype(np.int32), weight[order]
        self.start = np.searchsorted(cell[order], np.arange(self.blocks * terms + 1)).astype(np.int32)
        self.best = np.zeros((terms, self.blocks))
        np.maximum.at(self.best, (term, who // BLOCK), weight)

    def scores(self, blocks: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of the examples in some blocks, 0 for all others."""
        cells = (blocks[:, None] * self.terms + at[None]).ravel()
        begin = self.start[cells]
        sizes = self.start[cells + 1] - begin
        held = np.nonzero(sizes)[0]
        begin, sizes, w = begin[held], sizes[held], w[held % len(at)]
        ends = np.cumsum(sizes, dtype=np.int32)
        postings = np.repeat(begin - ends + sizes, sizes)
        postings += np.arange(len(postings), dtype=np.int32)
        return np.bincount(self.who[postings], np.repeat(w, sizes) * self.weight[postings], self.count)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples): the k of largest cosine above 0, ties to the smaller id; skip leaves one example out.

        The blocks of the best bounds are opened first; then all whose bound reaches the k-th best cosine."""
        top, who = np.zeros(0), np.zeros(0, np.int64)
        if not len(at) or not self.count:
            return top, who
        bound = w @ self.best[at]
        order = np.argsort(-bound, kind="stable")
        opened, step = 0, 6
        while opened < self.blocks:
            least = top[k - 1] if len(top) >= k else 0.0
            some = order[opened : opened + step]
            some = some[(bound[some] > 0) & (bound[some] * (1 + 1e-9) >= least)]
            if not len(some):
                break
            scores = self.scores(some, at, w)
            found = np.nonzero((scores > 0) & (scores >= least))[0]
            found = found[found != skip]
            top, who = np.concatenate([top, scores[found]]), np.concatenate([who, found])
            first = np.lexsort((self.ids[who], -top))[:k]
            top, who = top[first], who[first]
            opened, step = opened + step, self.blocks
        return top, who


class Model:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, terms: dict[bytes, int], scale: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], prior: float):
        """held has (term indices, counts) of each example; weights are the labelled rows that an example stands for."""
        self.ids, self.labels, self.weights, self.terms, self.scale, self.prior = ids, labels, weights, terms, scale, prior
        vectors = [vector(*h, scale) for h in held]
        self.index = BlockMaxIndex(vectors, len(terms), ids)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.none = prior
        if len(ids):
            votes = [self.vote(*self.index.nearest(*v, NEIGHBOURS, i)) for i, v in enumerate(vectors)]
            empty = np.array([v is None for v in votes])
            self.none = float((weights[empty] @ labels[empty] + prior) / (weights[empty].sum() + 1))
            if not empty.all():
                self.knots = isotonic(np.array([v for v in votes if v is not None]), labels[~empty], weights[~empty])

    def vote(self, cosines: np.ndarray, near: np.ndarray) -> float | None:
        """Share of label 1 among the neighbours: closeness 1 / (distance + 0.1), one pseudo-vote of the prior."""
        if not len(near):
            return None
        w = self.weights[near] / (1.1 - cosines)
        return float((w @ self.labels[near] + self.prior) / (w.sum() + 1))

    def score(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, cosines of the nearest examples, these examples)."""
        if not hasattr(self, "find"):
            self.find = TermCounts(self.terms)  # a worker keeps it between tasks, with the words it has met
        cosines, near = self.index.nearest(*vector(*self.find.of(text), self.scale), NEIGHBOURS)
        vote = self.vote(cosines, near)
        return (self.none if vote is None else float(np.interp(vote, *self.knots))), cosines, near


def term_scales(idf: np.ndarray, df: np.ndarray, pos: np.ndarray, rate: float) -> np.ndarray:
    """idf times the learned factor: z is how far `pos`, the examples with label 1 among the `df` that hold a term, lies from
    rate * df."""
    expected = df * rate
    z = (pos - expected) / np.sqrt(expected * (1 - rate) + 1e-9)
    return idf * np.maximum(FLOOR, np.minimum(1.0, np.abs(z) / FULL_Z))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of y on x by pooling, each pool at its mean x, ends at 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    at, value = np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])
    inner = (at > 0) & (at < 1)
    return np.concatenate([[0.0], at[inner], [1.0]]), np.concatenate([[0.0], value[inner], [1.0]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labels (id_col, label_col) of rows that are not held out; all driver data is bounded by the constants."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label, most in ((1, EXAMPLES_TOXIC), (0, EXAMPLES_CLEAN)):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, names, tfs = [], [], [], []
            for ident, label, text in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("text")):
                counts: Counter = Counter()
                for word, n in Counter(words_of(text.as_py() or b"")).items():
                    for t in terms_of(word):
                        counts[t] += n
                for t, n in (counts or {b"": 0}).items():
                    ids.append(ident), marks.append(label), names.append(t), tfs.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(names, pa.binary()), pa.array(tfs, pa.int64())], names=["id", "label", "term", "tf"])

    # at most EXAMPLES_TOXIC + EXAMPLES_CLEAN ids are broadcast
    examples = texts.join(F.broadcast(chosen), "id").mapInArrow(words, "id long, label int, term binary, tf long")
    examples = stored(examples, "examples")
    who = examples.groupBy("id").agg(F.max("label").alias("label")).toArrow()
    label_of = dict(zip(who.column("id").to_pylist(), who.column("label").to_pylist()))
    n1, n0 = sum(label_of.values()), len(label_of) - sum(label_of.values())
    prior = (total.get(1, 0) + 0.1) / (sum(total.values()) + 1)
    if not label_of:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), {}, np.zeros(0), [], prior)
    # labelled rows that an example stands for, and the share of all labelled rows that a term is held by
    w1, w0 = total.get(1, 0) / max(n1, 1), total.get(0, 0) / max(n0, 1)
    share = (F.col("pos") * w1 + (F.col("df") - F.col("pos")) * w0) / F.lit(n1 * w1 + n0 * w0)
    # an id whose text repeats is one example: its largest count holds
    once = examples.where("tf > 0").groupBy("id", "term").agg(F.max("label").alias("label"), F.max("tf").alias("tf"))
    chosen_terms = (
        once.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("pos"))
        .where((F.col("df") >= LEAST_SUPPORT) & share.between(LEAST_SHARE, MOST_SHARE))
        .toArrow()
        .sort_by("term")
    )
    terms = {t: i for i, t in enumerate(chosen_terms.column("term").to_pylist())}
    scale = term_scales(inverse_frequencies(texts, terms), chosen_terms.column("df").to_numpy().astype(float), chosen_terms.column("pos").to_numpy().astype(float), n1 / (n1 + n0))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in label_of}
    if terms:
        wanted = spark.createDataFrame(pa.table({"term": pa.array(list(terms), pa.binary()), "at": pa.array(range(len(terms)), pa.int64())}))
        rows = once.join(F.broadcast(wanted), "term").select("id", "at", "tf").toArrow()
        ident, at, tf = (rows.column(c).to_numpy() for c in ("id", "at", "tf"))
        order = np.lexsort((at, ident))
        ident, at, tf = ident[order], at[order], tf[order]
        cuts = np.nonzero(np.diff(ident))[0] + 1
        for i, a, n in zip(ident[np.concatenate([[0], cuts])].tolist() if len(ident) else [], np.split(at, cuts), np.split(tf, cuts)):
            held[i] = (a, n)
    discard(examples)
    ids = sorted(held)
    kind = clusters([vector(*held[i], scale) for i in ids], len(terms))
    order = [i for _, _, i in sorted(zip(kind, map(label_of.get, ids), ids))]
    label = np.array([label_of[i] for i in order], float)
    return Model(np.array(order, np.int64), label, np.where(label == 1, w1, w0), terms, scale, [held[i] for i in order], prior)


def inverse_frequencies(texts: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the term)) over all documents; tasks send one count per term."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(TermCounts(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df, n = held.value, np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[find.of(text.as_py() or b"")[0]] += 1
                n += 1
        some = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([n, *df[some].tolist()], pa.int64())], names=["at", "df"])

    counted = {r["at"]: r["df"] for r in texts.select("text").mapInArrow(count, "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()}
    total = counted.get(-1, 0)
    return np.array([math.log((1 + total) / (1 + counted.get(i, 0))) for i in range(len(terms))])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence): evidence names the nearest labelled examples."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, cosines, near = zip(*(model.score(text.as_py() or b"") for text in batch.column(1)))
            ends = np.cumsum([0, *map(len, near)])
            who = np.concatenate(near)
            found = pa.StructArray.from_arrays([pa.array(model.ids[who]), pa.array(np.concatenate(cosines)), pa.array(model.labels[who].astype(np.int32))], fields=list(EVIDENCE))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found).cast(SCORES.field(2).type)], schema=SCORES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(task, SCORES_DDL)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs whose score is under the threshold; rows are filtered where they are read, all columns pass through."""
    held, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            keep = [model.score((t.as_py() or "").encode())[0] < threshold for t in batch.column(column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
