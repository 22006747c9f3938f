"""The experiment modes as functions that return result rows as DataFrames."""

from __future__ import annotations

import itertools
import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import entropy, null_z
from ..operators import criterion, encode, lowrank, nulls, opponents, readout, verdict
from ..operators.candidates import all_pairs, frac_beaten, pool, sample
from ..operators.lags import with_lags  # noqa: F401 (kept for callers of this module)
from ..operators.split import strided  # noqa: F401
from ..sources import generators, tokens
from ..sources.packed import Packed, strided_lags
from ..sources.shared import stored
from . import cells
from .cells import Design, numbers, rows_frame

#: Lag pairs of the components streams: sharing lags, and disjoint.
SHARED_PAIRS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 5), (2, 5)]
DISJOINT_PAIRS = [(1, 2), (3, 4), (5, 6), (7, 8)]

CELL_DDL = "K int, n_cand int, samples int, seed int, W int, true_lag int, bar double, base_bits double, base_acc double, rank int, pick int, pick_bits double, pick_acc double, width int, ntr int, note string, oracle_bits double, wrong_lag int, wrong_bits double, null_mean double, null_std double, pick_z double, score_seconds double"


def run_cell(spark: SparkSession, K: int = 8, n_cand: int = 20, samples: int = 20_000, seed: int = 0, W: int = 10, k: int = 4, light: bool = False, draws: int = 20) -> dict:
    """One single-interaction cell: bar, additive, rank of the true lag, exact block of the pick, and the controls.

    The stream has 14 * samples positions at every size: with a stride of 7 and the first half for training, samples is
    the number of training rows but for the first positions, whose lags are undefined.  (The reference's samples is the
    length of the stream.)"""
    n = 2 * 7 * samples
    note = verdict.width_guard(K, W, pairs=0)
    if note:
        return {"K": K, "n_cand": n_cand, "samples": samples, "seed": seed, "W": W, "true_lag": k, "bar": math.log2(K), "note": note}
    stream = generators.single_interaction(spark, n, K, k, seed)
    d = cells.stream_design(stream, n, K, K, max(W, n_cand + 1), n_cand + 1, slots=list(range(W)))
    base = cells.fit_additive(d)
    held = numbers(readout.score(d.test, base))
    began = time.time()
    scores = stored(cells.lag_residual_scores(d, base, list(range(1, n_cand + 1))), "scores")
    seconds = time.time() - began
    _, best = cells.top(scores)
    row = {"K": K, "n_cand": n_cand, "samples": samples, "seed": seed, "W": W, "true_lag": k, "bar": math.log2(K), "base_bits": held["bits"], "base_acc": held["acc"], "rank": cells.rank_of(scores, 0, k), "pick": best, "ntr": d.n, "score_seconds": seconds}
    got = cells.exact_block(d, [("x0", f"x{best}")])
    row |= {"pick_bits": got["bits"], "pick_acc": got["acc"], "width": got["width"], "note": got["note"]}
    if light:
        return row
    _, wrong = cells.runner_up(scores)
    row["oracle_bits"] = cells.exact_block(d, [("x0", f"x{k}")])["bits"]
    row |= {"wrong_lag": wrong, "wrong_bits": cells.exact_block(d, [("x0", f"x{wrong}")])["bits"]}
    errs = readout.residuals(d.train, base)
    moved = nulls.permuted(errs, "t", f"x{best}", draws, seed)
    null = criterion.pair_scores(moved, ["x0", f"x{best}"], [f"e{c}" for c in range(K)], weighted=False, keys=["draw"])
    value = scores.where(F.col("j") == best).first()["score"]
    stats = null.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), null_z(F.lit(value), F.col("score")).alias("z")).first()
    return row | {"null_mean": stats["m"], "null_std": stats["s"], "pick_z": stats["z"]}


def demo(spark: SparkSession, **options) -> DataFrame:
    return rows_frame(spark, [run_cell(spark, **options)], CELL_DDL)


def envelope(spark: SparkSession, Ks=(8,), n_cands=(20,), samples=(20_000,), seeds=(0,), **options) -> DataFrame:
    grid = itertools.product(Ks, n_cands, samples, seeds)
    return rows_frame(spark, [run_cell(spark, K, c, s, seed, light=True, **options) for K, c, s, seed in grid], CELL_DDL)


ARM_DDL = "arm string, bits double, acc double, width int, seconds double, note string"


def timed(arm: str, made) -> dict:
    began = time.time()
    got = made()
    return {"arm": arm, "bits": got["bits"], "acc": got["acc"], "width": got.get("width") or got.get("parameters"), "note": got.get("note"), "seconds": time.time() - began}


def opponent(d: Design, kind: str, y: str = "y", classes: int | None = None, **options) -> dict:
    return numbers(opponents.fit_opponent(d.train, d.test, d.slots, d.sizes, y, classes or d.classes, kind, **options))


def vs_all(spark: SparkSession, K: int = 8, samples: int = 20_000, W: int = 5, k: int = 4, seed: int = 0, rounds: int = 10, with_fm: bool = True) -> DataFrame:
    """Additive, picked block, all crosses, boosted trees and factorisation machine on one task, and the additive check."""
    n = 4 * samples
    d = cells.stream_design(generators.single_interaction(spark, n, K, k, seed), n, K, K, W, W)
    base = cells.fit_additive(d)
    best = cells.top(cells.residual_scores(d, base, d.slots))
    rows = [
        timed("additive", lambda: numbers(readout.score(d.test, base)) | {"width": base.parameters}),
        timed("+pick", lambda: cells.exact_block(d, [(d.slots[best[0]], d.slots[best[1]])])),
        timed("+all crosses", lambda: cells.exact_block(d, all_pairs(d.slots))),
        timed("boosted trees", lambda: opponent(d, "gbt", rounds=rounds)),
    ]
    if with_fm:
        rows.append(timed("factorisation machine", lambda: opponent(d, "fm", rounds=10 * rounds)))
    easy = cells.stream_design(generators.additive_stream(spark, n, K, seed), n, K, K, W, W)
    rows.append(timed("check: boosted trees, additive task", lambda: opponent(easy, "gbt", rounds=rounds)))
    return rows_frame(spark, rows, ARM_DDL)


def vs_gbdt(spark: SparkSession, **options) -> DataFrame:
    return vs_all(spark, with_fm=False, **options)


BOOST_DDL = "M int, K int, arm string, round int, chosen string, hits int, bits double, bar double, additive_bits double, oracle_bits double, all_cross_bits double, all_cross_note string, gbt_bits double, fm_bits double"


def components_design(spark: SparkSession, M: int, K: int, samples: int, W: int, pairs: list, seed: int, comps: int = 2) -> tuple[Design, list]:
    truth = pairs[:M]
    reach = max(max(p) for p in truth)
    if reach >= W:
        raise ValueError(f"lag {reach} needs a window over {reach}")
    n = 4 * samples
    stream = generators.components_stream(spark, n, K, truth, comps, seed)
    return cells.stream_design(stream, n, K, comps**M, W, W, heads=[f"y_{m}" for m in range(M)]), truth


def greedy(d: Design, rounds: int, y: str = "y", classes: int | None = None) -> list[dict]:
    """Boosting over pairs: score the residual, add the best remaining pair's exact block, refit; one row per round."""
    chosen: list[tuple[int, int]] = []
    model, frame, out = cells.fit_additive(d, y, classes), d.train, []
    everything = all_pairs(list(range(len(d.slots))))
    for step in range(rounds):
        left = [p for p in everything if p not in chosen]
        errs = readout.residuals(frame, model, y)
        scores = criterion.pair_scores(errs, d.slots, [f"e{c}" for c in range(model.classes)], False, pairs=left)
        chosen.append(cells.top(scores))
        train, test, names = d.train, d.test, []
        for m, (i, j) in enumerate(chosen):
            names.append(f"cell{m}")
            train = cells.with_cell(train, d.slots[i], d.slots[j], d.alphabet, names[-1])
            test = cells.with_cell(test, d.slots[i], d.slots[j], d.alphabet, names[-1])
        if d.alphabet * len(d.slots) + len(chosen) * d.alphabet**2 > 6000:
            break
        model = readout.fit_readout(train, [*d.slots, *names], [*d.sizes, *[d.alphabet**2] * len(names)], y, classes or d.classes, d.ordinal, d.n)
        frame = train
        out.append({"round": step + 1, "chosen": chosen[-1], "bits": numbers(readout.score(test, model, y))["bits"]})
    return out


def boosting(spark: SparkSession, M: int = 2, K: int = 8, samples: int = 20_000, W: int = 6, extra: int = 1, disjoint: bool = False, seed: int = 0, rounds: int | None = None, with_opponents: bool = True, opponent_rounds: int = 60, epochs: int = 300) -> DataFrame:
    """M interactions packed in one target of 2^M classes: greedy rounds with hits, the floor, additive and oracle.

    Every row also holds the task's all-crosses block (null with a note where it is too wide) and both opponents."""
    d, truth = components_design(spark, M, K, samples, W, DISJOINT_PAIRS if disjoint else SHARED_PAIRS, seed)
    additive = numbers(readout.score(d.test, cells.fit_additive(d)))["bits"]
    oracle = cells.exact_block(d, [(f"x{a}", f"x{b}") for a, b in truth])["bits"]
    crosses = cells.exact_block(d, all_pairs(d.slots))
    fixed = {"all_cross_bits": crosses["bits"], "all_cross_note": crosses["note"]}
    if with_opponents:
        fixed |= {"gbt_bits": opponent(d, "gbt", rounds=opponent_rounds)["bits"], "fm_bits": opponent(d, "fm", rounds=epochs)["bits"]}
    rows, found = [], set()
    for r in greedy(d, rounds or M + extra):
        found.add(tuple(sorted(int(d.slots[x][1:]) for x in r["chosen"])))
        rows.append({"M": M, "K": K, "arm": "boosting", "round": r["round"], "chosen": str(sorted(found)), "hits": len(found & set(truth)), "bits": r["bits"], "bar": float(M), "additive_bits": additive, "oracle_bits": oracle} | fixed)
    return rows_frame(spark, rows, BOOST_DDL)


def boosting2(spark: SparkSession, Ms=(1, 2), **options) -> DataFrame:
    """boosting over several M with each row's instrument gates."""
    out = None
    for M in Ms:
        got = boosting(spark, M=M, **options)
        out = got if out is None else out.unionByName(got)
    return verdict.instrument_gates(out, "bar", "additive_bits", "oracle_bits")


MULTI_DDL = "M int, K int, chosen string, hits int, mean_bits double, method string, parameters int"


def multi(spark: SparkSession, M: int = 2, K: int = 8, samples: int = 20_000, W: int = 6, seed: int = 0, lowrank_heads: bool = False, dim: int = 4, rounds: int | None = None) -> DataFrame:
    """One two-class head per interaction on a shared design.

    Each round scores the remaining pairs by the criterion summed over the heads' residuals, adds the best pair's block
    to every head and refits; parameters grow with the heads, not with their combinations."""
    d, truth = components_design(spark, M, K, samples, W, SHARED_PAIRS, seed)
    heads = [f"y_{m}" for m in range(M)]
    models = [cells.fit_additive(d, h, 2) for h in heads]
    chosen: list[tuple[int, int]] = []
    everything = all_pairs(list(range(len(d.slots))))
    train, test, names = d.train, d.test, []
    for step in range(rounds or M):
        frame = train
        for m, (h, model) in enumerate(zip(heads, models)):
            frame = readout.residuals(frame, model, h, f"h{m}_")
        errs = [f"h{m}_{c}" for m in range(M) for c in range(2)]
        scores = criterion.pair_scores(frame, d.slots, errs, False, pairs=[p for p in everything if p not in chosen])
        i, j = cells.top(scores)
        chosen.append((i, j))
        names.append(f"cell{step}")
        train = cells.with_cell(train, d.slots[i], d.slots[j], d.alphabet, names[-1])
        test = cells.with_cell(test, d.slots[i], d.slots[j], d.alphabet, names[-1])
        if lowrank_heads:
            models = [lowrank.fit_lowrank(train, d.slots, d.sizes, names, d.alphabet, h, 2, d.ordinal, d.n, dim)[0] for h in heads]
        else:
            models = [readout.fit_readout(train, [*d.slots, *names], [*d.sizes, *[d.alphabet**2] * len(names)], h, 2, d.ordinal, d.n) for h in heads]
    bits = [numbers(readout.score(test, model, h))["bits"] for h, model in zip(heads, models)]
    lags = {tuple(sorted((int(d.slots[i][1:]), int(d.slots[j][1:])))) for i, j in chosen}
    row = {"M": M, "K": K, "chosen": str(sorted(lags)), "hits": len(lags & set(truth)), "mean_bits": sum(bits) / len(bits), "method": "lowrank" if lowrank_heads else "exact", "parameters": sum(m.parameters for m in models)}
    return rows_frame(spark, [row], MULTI_DDL)


def alsmulti(spark: SparkSession, **options) -> DataFrame:
    return multi(spark, lowrank_heads=True, **options)


def speed(spark: SparkSession, K: int = 16, samples: int = 20_000, W: int = 6, opponent_rounds: int = 60, epochs: int = 100, with_opponents: bool = True) -> DataFrame:
    """Wall seconds of the hot paths, of the dense fit that they replace, and of both opponents on one design."""
    n = 4 * samples
    d = cells.stream_design(generators.single_interaction(spark, n, K, 4, 0), n, K, K, W, W)
    base = cells.fit_additive(d)
    rivals = [timed("boosted trees", lambda: opponent(d, "gbt", rounds=opponent_rounds)), timed("factorisation machine", lambda: opponent(d, "fm", rounds=epochs))] if with_opponents else []
    return rows_frame(
        spark,
        [
            timed("read-out fit", lambda: (cells.fit_additive(d), {"bits": None, "acc": None, "width": base.parameters})[1]),
            timed("dense read-out fit", lambda: (readout.solve_ridge(*readout.dense_products(d.train, d.slots, d.sizes, "y", d.classes), 1e-2), {"bits": None, "acc": None, "width": base.parameters})[1]),
            timed("criterion, all pairs", lambda: (cells.residual_scores(d, base, d.slots).count(), {"bits": None, "acc": None})[1]),
            timed("exact block", lambda: cells.exact_block(d, [("x0", "x4")])),
            timed("low-rank block", lambda: cells.lowrank_block(d, [("x0", "x4")])[0]),
            *rivals,
        ],
        ARM_DDL,
    )


def als(spark: SparkSession, K: int = 8, samples: int = 20_000, W: int = 5, k: int = 4, dim: int = 8, sweeps: int = 6, seed: int = 0) -> DataFrame:
    """Exact table against the low-rank block, by alternating solves and by gradients."""
    n = 4 * samples
    d = cells.stream_design(generators.single_interaction(spark, n, K, k, seed), n, K, K, W, W)
    pair = [("x0", f"x{k}")]
    note = verdict.identifiable(int(d.n * 0.7), verdict.parameters("exact", K, K, W))
    return rows_frame(
        spark,
        [
            timed("exact", lambda: {"bits": None, "acc": None, "note": note} if note else cells.exact_block(d, pair)),
            timed("alternating solves", lambda: cells.lowrank_block(d, pair, dim=dim, sweeps=sweeps)[0]),
            timed("gradients", lambda: cells.lowrank_block(d, pair, dim=dim, method="gradient")[0]),
        ],
        ARM_DDL,
    )


POOL_DDL = "N int, W int, rank int, pick_i int, pick_j int, score double, threshold double, clears boolean, bits double, additive_bits double, bar double"


def pool_mode(spark: SparkSession, N: int = 45, K: int = 8, samples: int = 20_000, a: int = 1, b: int = 4, draws: int = 20, dim: int = 8, seed: int = 0) -> DataFrame:
    """Rank of the true pair in a pool of N lag pairs, the null of the best of N (each with its own shuffle), and what the pick is worth."""
    window, pairs = pool(N)
    n = 4 * samples
    stream = generators.components_stream(spark, n, K, [(a, b)], 2, seed)
    d = cells.stream_design(stream, n, K, 2, window, window)
    base = cells.fit_additive(d)
    errs = stored(readout.residuals(d.train, base), "errs")
    names = [f"e{c}" for c in range(2)]
    scores = stored(criterion.pair_scores(errs, d.slots, names, False, pairs=pairs), "scores")
    threshold = nulls.null_threshold(nulls.own_shuffle_null(errs, "t", d.slots, pairs, names, draws, seed)).first()["threshold"]
    i, j = cells.top(scores)
    best = scores.where((F.col("i") == i) & (F.col("j") == j)).first()["score"]
    got, _ = cells.lowrank_block(d, [(d.slots[i], d.slots[j])], dim=dim)
    row = {"N": N, "W": window, "rank": cells.rank_of(scores, a, b), "pick_i": i, "pick_j": j, "score": best, "threshold": threshold, "clears": best > threshold, "bits": got["bits"], "additive_bits": numbers(readout.score(d.test, base))["bits"], "bar": 1.0}
    return rows_frame(spark, [row], POOL_DDL)


def emit(spark: SparkSession, K: int = 8, samples: int = 20_000, dim: int = 8, sweeps: int = 8, a: int = 1, b: int = 2, seed: int = 0) -> DataFrame:
    """(a, b, g, truth, n): the emitted interaction table beside the rule that made the data and the cell counts."""
    n = 4 * samples
    d = cells.stream_design(generators.components_stream(spark, n, K, [(a, b)], 2, seed), n, K, 2, b + 2, b + 2)
    _, factors = cells.lowrank_block(d, [(f"x{a}", f"x{b}")], dim=dim, sweeps=sweeps)
    made = lowrank.emit_table(spark, factors, centred=True)
    counts = d.train.groupBy(F.col(f"x{a}").alias("a"), F.col(f"x{b}").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return made.join(counts, ["a", "b"], "left").select("a", "b", "g", ((F.col("a") + F.col("b")) % 2).cast("int").alias("truth"), F.coalesce("n", F.lit(0)).alias("n"))


def table_accuracy(emitted: DataFrame) -> DataFrame:
    """(exact, weighted): share of right entries, and weighted by cell counts."""
    right = (F.col("g") == F.col("truth")).cast("int")
    return emitted.agg(F.avg(right).alias("exact"), (F.sum(F.col("n") * right) / F.sum("n")).alias("weighted"))


REAL_DDL = "rare int, noise double, informative double, label_entropy double, rank_equal int, rank_weighted int, max_share double, occupied double, bits double"


def real(spark: SparkSession, symbols: DataFrame | Packed, n: int, K: int, a: int = 1, b: int = 8, window: int = 10, noise: float = 0.0, rare: int = 0, stride: int = 40, seed: int = 0) -> DataFrame:
    """An injected signal on a real symbol stream, packed or (t, x): ranks by the equal-weight and the count-weighted criterion."""
    rows = strided_lags(symbols, list(range(window + 1)), window + 1, stride)
    rows = generators.injected(rows, f"x{a}", f"x{b}", 2, noise, seed)
    if rare:
        rows = generators.rare_signal(rows, f"x{a}", rare, 2, seed, K)
    else:
        rows = rows.withColumn("informative", F.lit(True))
    rows = stored(rows, "real")
    count = max(0, -(-(n - window - 1) // stride))
    d = Design(rows, rows, F.floor((F.col("t") - window - 1) / stride), count, [f"x{j}" for j in range(1, window + 1)], K, 2)
    base = cells.fit_additive(d)
    row = numbers(rows.agg(F.avg(F.col("informative").cast("int")).alias("informative")))
    row |= {"label_entropy": entropy(rows, "y").first()["entropy"], "bits": numbers(readout.score(d.test, base))["bits"]}
    errs = [f"e{c}" for c in range(base.classes)]
    both = stored(criterion.coded_cells(readout.residuals(d.train, base), d.slots, errs, K), "cells")
    for name, weighted in (("rank_equal", False), ("rank_weighted", True)):
        row[name] = cells.rank_of(criterion.scores_of_cells(both, len(errs), weighted), a - 1, b - 1)
    row |= numbers(criterion.cell_shares(rows, f"x{a}", f"x{b}", K)) | {"rare": rare, "noise": noise}
    return rows_frame(spark, [row], REAL_DDL)


#: Up to this many pairs natural fits every one of them to rank the pick.
MOST_RANKED = 80

NATURAL_DDL = "K int, pick_i int, pick_j int, rank_by_bits int, additive_bits double, pick_bits double, random_mean double, frac_beaten double"


def natural(spark: SparkSession, symbols: DataFrame | Packed, n: int, K: int, window: int = 10, stride: int = 40, n_rand: int = 8, dim: int = 8, seed: int = 0) -> DataFrame:
    """Next-symbol target, nothing injected; all bits are read on rows after the fitted ones.

    rank_by_bits is the pick's place among all pairs, each of them fitted, and null above MOST_RANKED pairs; random_mean
    and frac_beaten are over a hash sample of n_rand other pairs."""
    rows = stored(strided_lags(symbols, list(range(window + 1)), window + 1, stride).withColumn("y", F.col("x0")), "natural")
    count = max(0, -(-(n - window - 1) // stride))
    ordinal = F.floor((F.col("t") - window - 1) / stride)
    cut = int(count * 0.7)
    d = Design(rows.where(ordinal < cut), rows.where(ordinal >= cut), ordinal, cut, [f"x{j}" for j in range(1, window + 1)], K, K)
    base = cells.fit_additive(d)
    i, j = cells.top(cells.residual_scores(d, base, d.slots, weighted=True))
    everything = all_pairs(list(range(window)))
    every = spark.createDataFrame(everything, "i int, j int").where((F.col("i") != i) | (F.col("j") != j))
    drawn = [(r["i"], r["j"]) for r in sample(every, n_rand, seed).collect()]
    ranks = len(everything) <= MOST_RANKED
    bits = {p: cells.lowrank_block(d, [(d.slots[p[0]], d.slots[p[1]])], dim=dim)[0]["bits"] for p in (everything if ranks else [(i, j), *drawn])}
    pick, others = bits[i, j], [bits[p] for p in drawn]
    rank = 1 + sum((b, p) < (pick, (i, j)) for p, b in bits.items()) if ranks else None
    against = spark.createDataFrame([(b,) for b in others], "bits double")
    row = {"K": K, "pick_i": i + 1, "pick_j": j + 1, "rank_by_bits": rank, "additive_bits": numbers(readout.score(d.test, base))["bits"], "pick_bits": pick, "random_mean": sum(others) / len(others), "frac_beaten": frac_beaten(against, pick).first()["frac_beaten"]}
    return rows_frame(spark, [row], NATURAL_DDL)


FIELDS_DDL = "F int, K int, n int, note string, label_entropy double, rank int, additive_bits double, pick_bits double, lowrank_bits double, gbt_bits double, fm_bits double, pick_i int, pick_j int, n_cand int, rank_pick_bits int, rank_true_bits int, truth_bits double, frac_beaten double, table_exact double, table_weighted double"

#: Up to this many pairs fields fits every one of them; above, the pick is held against random pairs.
MOST_FIELD_PAIRS = 200


def record_design(spark: SparkSession, words: DataFrame, fields: int, K: int, limit: int, seed: int) -> tuple[Design, DataFrame]:
    rows = stored(tokens.records(words, fields, limit, seed, K), "records")
    n = rows.count()
    cut = int(n * 0.7)
    return Design(rows.where(F.col("rec") < cut), rows.where(F.col("rec") >= cut), F.col("rec"), cut, [f"f{k}" for k in range(fields)], K, 2), rows


def against_pairs(d: Design, pick: tuple[int, int], bits: float, n_rand: int, seed: int) -> dict:
    """The pick's and the true (first, last) pair's ranks by bits over all pairs, or the share of random pairs it beats."""
    everything, truth = all_pairs(list(range(len(d.slots)))), (0, len(d.slots) - 1)

    def held(p: tuple[int, int]) -> float:
        return bits if p == pick else cells.lowrank_block(d, [(d.slots[p[0]], d.slots[p[1]])])[0]["bits"]

    if len(everything) <= MOST_FIELD_PAIRS:
        every = {p: held(p) for p in everything}
        order = sorted(everything, key=lambda p: (every[p], p))
        return {"n_cand": len(everything), "rank_pick_bits": order.index(pick) + 1, "rank_true_bits": order.index(truth) + 1, "truth_bits": every[truth]}
    spark = d.train.sparkSession
    others = spark.createDataFrame([p for p in everything if p != pick], "i int, j int")
    drawn = spark.createDataFrame([(held((r["i"], r["j"])),) for r in sample(others, n_rand, seed).collect()], "bits double")
    return {"n_cand": len(everything), "frac_beaten": frac_beaten(drawn, bits).first()["frac_beaten"]}


def fields_mode(spark: SparkSession, words: DataFrame, fields: int = 7, K: int = 16, limit: int = 20_000, seed: int = 0, with_opponents: bool = True, rounds: int = 10, n_rand: int = 20) -> DataFrame:
    """A parity of two fields of word-block records: gates, rank of the true pair, blocks and opponents.

    Up to MOST_FIELD_PAIRS pairs, the pick and the true pair are ranked by low-rank bits over all pairs; above, frac_beaten
    is over n_rand random pairs.  The emitted table is scored where the pick is the true pair."""
    d, rows = record_design(spark, words, fields, K, limit, seed)
    row: dict = {"F": fields, "K": K, "n": rows.count(), "label_entropy": entropy(rows, "y").first()["entropy"] or 0.0}
    poor = encode.degenerate_fields(rows, d.slots).where("degenerate").count()
    gate = spark.range(1).select(verdict.entropy_gate(F.lit(row["label_entropy"])).alias("note")).first()["note"]
    if gate:
        row["note"] = gate
    elif poor:
        row["note"] = f"DEGENERATE: {poor} fields with fewer than 3 values"
    else:
        base = cells.fit_additive(d)
        scores = stored(cells.residual_scores(d, base, d.slots, weighted=True), "scores")
        i, j = cells.top(scores)
        pair = [(d.slots[i], d.slots[j])]
        row |= {"rank": cells.rank_of(scores, 0, fields - 1), "additive_bits": numbers(readout.score(d.test, base))["bits"], "pick_bits": cells.exact_block(d, pair)["bits"], "pick_i": i, "pick_j": j}
        picked, factors = cells.lowrank_block(d, pair)
        row |= {"lowrank_bits": picked["bits"]} | against_pairs(d, (i, j), picked["bits"], n_rand, seed)
        if (i, j) == (0, fields - 1):
            counts = d.train.groupBy(F.col(d.slots[i]).alias("a"), F.col(d.slots[j]).alias("b")).agg(F.count(F.lit(1)).alias("n"))
            emitted = lowrank.emit_table(spark, factors, centred=True).join(counts, ["a", "b"], "left").fillna(0, ["n"])
            right = numbers(table_accuracy(emitted.withColumn("truth", (F.col("a") + F.col("b")) % 2)))
            row |= {"table_exact": right["exact"], "table_weighted": right["weighted"]}
        if with_opponents:
            row |= {"gbt_bits": opponent(d, "gbt", rounds=rounds)["bits"], "fm_bits": opponent(d, "fm", rounds=5 * rounds)["bits"]}
    return rows_frame(spark, [row], FIELDS_DDL)


TUNE_DDL = "kind string, depth int, rounds int, rate double, dim int, bits double, acc double, seconds double, pick_i int, pick_j int"


def tune(spark: SparkSession, words: DataFrame, fields: int = 7, K: int = 16, limit: int = 5_000, seed: int = 0, grid: list[dict] | None = None) -> DataFrame:
    """The additive fit, the criterion's pick with its low-rank block, and budget curves of the opponents on the records task."""
    d, _ = record_design(spark, words, fields, K, limit, seed)
    grid = grid or [{"kind": "gbt", "depth": 2, "rounds": r, "rate": 0.3} for r in (5, 10)] + [{"kind": "fm", "dim": 4, "rounds": 50, "rate": 0.05}]
    began = time.time()
    base = cells.fit_additive(d)
    rows = [{"kind": "additive"} | numbers(readout.score(d.test, base)) | {"seconds": time.time() - began}]
    i, j = cells.top(cells.residual_scores(d, base, d.slots, weighted=True))
    got = cells.lowrank_block(d, [(d.slots[i], d.slots[j])], dim=8)[0]
    rows.append({"kind": "ours", "dim": 8, "bits": got["bits"], "acc": got["acc"], "seconds": time.time() - began, "pick_i": i, "pick_j": j})
    for g in grid:
        got = timed(g["kind"], lambda: opponent(d, **g))  # noqa: B023
        rows.append(g | {"bits": got["bits"], "acc": got["acc"], "seconds": got["seconds"]})
    return rows_frame(spark, rows, TUNE_DDL)


def gbm(spark: SparkSession, words: DataFrame, **options) -> DataFrame:
    """The deeper boosted-tree grid; MLlib's trees stand in for a library that is not installed, under their own name."""
    grid = [{"kind": "gbt", "depth": depth, "rounds": rounds, "rate": rate} for depth, rounds, rate in ((3, 10, 0.1), (3, 20, 0.1), (5, 10, 0.1), (5, 10, 0.3))]
    return tune(spark, words, grid=options.pop("grid", grid), **options)
