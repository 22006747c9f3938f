"""MinHash near-duplicates with tensored banding.

Two small collections of sub-signatures A_1..A_m and B_1..B_m are hashed per document; the m*m tables are keyed by all
combinations (A_i, B_j).  That takes 2*m*r minhashes where independent tables would take 2*m*m*r.

Texts with equal shingle sets are one class.  Classes that share a table key are candidates; to keep hot keys linear,
a key first compares all its members with one leader, then, where members are still apart, with the member that has
most links; whatever is still apart is compared by an exact prefix join on the shingles themselves.  No pair of different
components that shares a key is skipped, so no cap exists.  Candidates pass a size bound (exact) and a 2-bit sketch
bound, and links are confirmed on full shingle sets.

Keys of large groups are tables of their own before their members are joined, so that a key of a third of all rows is dealt
to many tasks.

Defined cases: null and empty texts have an empty set, no links, and stay; a null id takes no part in links and is kept; an
id is one document: where rows repeat an id with different texts, all of its texts are in one component and a link of any
of them is a link of the id, whatever the order of the rows; an empty table gives an empty table; drop_near_duplicates
passes all columns through under any name and drops every row of an id that goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, stored
from .components import connected_components
from .words import WordHashes, shingles

#: Missed with probability 2 * (1 - J**r)**m at similarity J: 7e-5 at 0.85, 2e-6 at 0.9 for m=8, r=2.
M, R = 8, 2
#: Cells (of 2*m*r, two bits each) that may differ; at J=0.8 more differ with probability 1e-4, at 0.85 with 4e-6.
CELLS = 13
#: Ids of candidates that may be broadcast (8 bytes each); above this, texts are joined by shuffle.
BROADCAST_IDS = 500_000

SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bits", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
SKETCH_DDL = "id long, n int, set_a long, set_b long, bits long, a array<long>, b array<long>"


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    draw = rng.integers(0, 2**64, size=(2, count), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minhashes(sets: np.ndarray, mul: np.ndarray, xor: np.ndarray) -> np.ndarray:
    """One minimum per hash function; a block of shingles at a time bounds memory for very long texts."""
    best = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        block = sets[at : at + 4096]
        for i in range(len(mul)):
            low = ((block ^ xor[i]) * mul[i]).min()
            if low < best[i]:
                best[i] = low
    return best


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(29))


def sketch(sets: np.ndarray, mul: np.ndarray, xor: np.ndarray, m: int, r: int) -> tuple:
    """(set hash a, b, packed 2-bit cells, A sub-signatures, B sub-signatures) of a non-empty set."""
    low = mixed(minhashes(sets, mul, xor))
    cells = low[:32] & np.uint64(3)
    bits = np.bitwise_or.reduce(cells << (np.arange(len(cells), dtype=np.uint64) * np.uint64(2)))
    parts = low.reshape(2 * m, r)
    keys = np.zeros(2 * m, np.uint64)
    for j in range(r):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    keys = mixed(keys + np.arange(2 * m, dtype=np.uint64)).view(np.int64)
    set_a, set_b = np.array([sets.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(sets))]).view(np.int64)
    return int(set_a), int(set_b), int(bits.view(np.int64)), keys[:m], keys[m:]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, m: int = M, r: int = R) -> DataFrame:
    mul, xor = coefficients(2 * m * r)
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sets = np.unique(shingles(hashes.of(text.as_py() or b""), words))
                rows.append((ident, len(sets), *(sketch(sets, mul, xor, m, r) if len(sets) else (0, 0, 0, None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SKETCH.types)], schema=SKETCH)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(task, SKETCH_DDL)


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int, repeated: bool = True) -> DataFrame:
    """(id, set, parity): the distinct full shingle sets of the given ids, and for each the parities of its shingles in 512 cells.

    Every shingle that only one of two sets holds flips one cell, so sets differ by as many shingles as their parities
    differ in cells, at least."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    few = ids.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "id", "left_semi")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [np.unique(shingles(hashes.of(t.as_py() or b""), words)) for t in batch.column(1)]
            cells = [np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % 512, minlength=512).astype(np.uint8) & 1).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], cells))], names=["id", "set", "parity"])

    found = chosen.mapInArrow(task, "id long, set array<long>, parity array<long>")
    return found.dropDuplicates(["id", "set"]) if repeated else found


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (x, y) with 100 * intersection >= percent * union on full sets (id, set), as a stored table."""
    left = sets.select(F.col("id").alias("x"), F.col("set").alias("sx"))
    right = sets.select(F.col("id").alias("y"), F.col("set").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    union = F.size("sx") + F.size("sy") - both
    return stored(pairs.join(left, "x").join(right, "y").where(100 * both >= percent * union).select("x", "y").distinct(), "confirmed")


def prefix_pairs(placed: DataFrame, sets: DataFrame, percent: int, similar) -> DataFrame:
    """Candidate pairs (x, y) across components among placed (id, n, bits, part), complete for the threshold.

    Sets that can link share one of their rarest n - ceil(percent * n / 100) + 1 shingles, in any order that is the same
    for all sets.  The order here puts shingles of a single component first: they find nothing, so a text with that
    many shingles of its own is out, and all others look up only what is left of their prefix.  Rows grow with the texts,
    not with the pairs of a group of edited copies."""
    # `which` tells the sets of an id apart where rows repeat it
    sets = sets.select("id", F.xxhash64("set").alias("which"), "set", "parity")
    each = placed.join(sets, "id").where(F.size("set") == F.col("n")).select("id", "which", "n", "bits", "part", F.explode("set").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("shingle", "df")
    common = stored(common, "common-shingles")
    held = each.join(common, "shingle").groupBy("id", "which", "n", "bits", "part").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    own = F.col("n") - F.size("held")
    prefix = held.where(length > own).select("id", "which", "n", "bits", "part", own.alias("own"), F.posexplode(F.slice("held", F.lit(1), (length - own).cast("int"))).alias("at", "p"))
    prefix = stored(prefix.join(sets.select("id", "which", "parity"), ["id", "which"]).select("id", "n", "bits", "part", "parity", (F.col("n") - F.col("own") - F.col("at")).alias("rest"), F.col("p.shingle").alias("shingle")), "prefixes")
    # one side of a pair is outside the shingle's first component, so a large component never meets itself
    first = prefix.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("shingle", "lo")
    first = stored(first, "first-parts")
    named = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "bits", "part", "rest", "parity")]
    # at its first common shingle a pair's sets hold `rest` shingles still, which must reach the least intersection
    enough = F.least("x_rest", "y_rest") * F.lit(100 + percent) >= percent * (F.col("x_n") + F.col("y_n"))
    apart = sum((F.bit_count(F.col("x_parity")[k].bitwiseXOR(F.col("y_parity")[k])) for k in range(8)), F.lit(0))
    enough &= F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("x_n") + F.col("y_n"))
    outer = prefix.join(first, "shingle").where("part <> lo").select("shingle", "lo", *named("x"))
    met = outer.join(prefix.select("shingle", *named("y")), "shingle").where((F.col("x_part") != F.col("y_part")) & ((F.col("y_part") == F.col("lo")) | (F.col("x_id") < F.col("y_id"))) & enough & similar)
    return met.select(F.least("x_id", "y_id").alias("x"), F.greatest("x_id", "y_id").alias("y")).distinct()


def linked_components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, m: int, r: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored sketches of all rows, stored (id, n, rep) of the rows that have a set and an id, rep being the smallest id of an
    equal set, and stored (id, component) of the representatives that have links."""
    all_sketches = stored(sketches(docs, id_col, text_col, words, m, r), "sketches")
    full = all_sketches.where("n > 0 and id is not null")
    # a table of its own, so that rows meet a class of a third of them in many tasks
    classes = stored(full.groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep")), "classes")
    placed = stored(full.select("id", "n", "set_a", "set_b").join(classes, ["n", "set_a", "set_b"]).select("id", "n", "rep"), "classed")
    # an id that repeats with different texts can stand for several classes; its rows here are then several
    reps = full.join(classes, ["n", "set_a", "set_b"]).where("id = rep").dropDuplicates(["id", "n", "set_a", "set_b"]).select("id", "n", "bits", "a", "b")
    spread = stored(placed.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", "x", "hi"), "repeated")
    repeated = not spread.isEmpty()
    same = placed.select("id", "rep").join(spread.where("x < hi"), "id").where("rep > x").select("x", F.col("rep").alias("y")).distinct()
    table = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key")
    members = reps.select("id", "n", "bits", table)

    x, y = "x", "y"
    differ = F.col("x_bits").bitwiseXOR(F.col("y_bits"))
    cells = F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    similar = (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (cells <= CELLS)

    # first star: members against the smallest id of their key
    keys = members.groupBy("key").agg(F.min("id").alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    keys = stored(keys, "keys")
    shared = stored(members.join(keys, "key"), "shared")
    facts = reps.select("id", "n", "bits")
    leaders = facts.select(F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("bits").alias("x_bits"))
    star = shared.where("id <> x").select("x", F.col("id").alias("y"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits")).distinct()
    tried = star.join(leaders, "x").where(similar).select("x", "y")

    def settled(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = stored(candidates, "pairs")
        ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
        return pairs, confirmed(pairs, stored(sets_of(docs, ids, id_col, text_col, words, repeated), "sets"), percent)

    tried, links = settled(tried)
    if repeated:
        links = links.unionByName(stored(same, "same-id"))
    parts = stored(connected_components(links, "x", "y"), "parts")

    def apart(parts: DataFrame) -> DataFrame:
        """Members of the keys that still hold several components, with their component."""
        placed = shared.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
        open_keys = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        open_keys = stored(open_keys, "open-keys")
        return stored(placed.join(open_keys, "key").select("key", "id", "n", "bits", F.col("x").alias("leader"), "part"), "apart")

    # second star: against the member with most links
    degree = links.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    open1 = apart(parts)
    if open1.isEmpty():
        return all_sketches, placed, parts
    hubs = open1.join(degree, "id").where("id <> leader").groupBy("key").agg(F.max(F.struct("degree", "id", "n", "bits", "part")).alias("hub")).select("key", F.col("hub.id").alias("x"), F.col("hub.n").alias("x_n"), F.col("hub.bits").alias("x_bits"), F.col("hub.part").alias("x_part"))
    hubs = stored(hubs, "hubs")
    second = (
        open1.join(hubs, "key")
        .where("part <> x_part and id <> leader")
        .select("x", "x_n", "x_bits", F.col("id").alias("y"), F.col("n").alias("y_n"), F.col("bits").alias("y_bits"))
        .where(similar)
        .select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
        .distinct()
    )
    second, more = settled(second)
    open2 = open1
    if not more.isEmpty():
        links = links.unionByName(more)
        parts = stored(connected_components(links, "x", "y"), "parts")
        open2 = apart(parts)

    # the rest: members of keys that hold several components, all of them
    sets = stored(sets_of(docs, open2.select("id").distinct(), id_col, text_col, words, repeated), "sets")
    third = prefix_pairs(open2.select("id", "n", "bits", "part").distinct(), sets, percent, similar)
    last = confirmed(stored(third, "pairs"), sets, percent)
    if not last.isEmpty():
        parts = stored(connected_components(links.unionByName(last), "x", "y"), "parts")
    return all_sketches, placed, parts


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, m: int = M, r: int = R) -> DataFrame:
    """(id, n_shingles, component_id) per row of docs; links need percent/100 similarity of word shingle sets."""
    with scratch() as keep:
        all_sketches, placed, parts = linked_components(docs, id_col, text_col, words, percent, m, r)
        keep(all_sketches), keep(placed), keep(parts)
    classed = placed.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    grouped = classed.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    rest = all_sketches.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return grouped.unionByName(rest)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the members of each near-duplicate group but the one with the smallest id."""
    with scratch() as keep:
        found = near_components(docs, id_col, text_col, words, percent)
        gone = stored(found.where("component_id < id").select(F.col("id").alias(id_col)).distinct(), "gone")
        keep(gone)
    return docs.join(gone, id_col, "left_anti")
