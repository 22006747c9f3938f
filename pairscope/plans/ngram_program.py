"""The n-gram program: corpus to symbols, vocabulary on the training side, the smoothed family, leak control and bar.

python -m pairscope.plans.ngram_program --documents PARQUET [--gran byte,word] [--k 16,64] [--lag 1,2,4,8,16] [--orders 4] [--sanity]"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import ngram, verdict
from ..operators.split import eval_positions
from ..sources import generators
from ..sources.packed import Packed, Symbols, contexts, packed
from ..sources.shared import scratch, stored
from .cells import rows_frame

STEPS, TRAIN_BLOCKS, BLOCKS = 24, 7, 8
CARD_DDL = "gran string, k int, lag int, order int, alpha double, bps double, acc double, n long, unk_true_rate double, unk_pred_rate double, bps_real double, acc_real double, n_real long, unigram_bps double"
STATS_DDL = "gran string, k int, n long, train_end long, train_unk_rate double, test_unk_rate double, top1_share double, freq_kl double"


@dataclass
class Prepared:
    """A coded stream (t, x) with its split and statistics."""

    gran: str
    k: int
    stream: DataFrame
    n: int
    train_end: int
    packed: Packed


def symbols(texts: DataFrame, id_col: str, text_col: str, gran: str) -> Symbols:
    """The bytes or words of all texts in id order."""
    return Symbols(texts, id_col, text_col, gran)


def prepare(raw: Symbols, gran: str, k: int) -> Prepared:
    stream, n, end = packed(raw, k, (TRAIN_BLOCKS, BLOCKS))
    return Prepared(gran, k, stream.stream(), n, end, stream)


def statistics(p: Prepared) -> DataFrame:
    """One row: unknown rates of both sides, the share of the first symbol, divergence of the test block."""
    train, test = p.stream.where(F.col("t") < p.train_end), p.stream.where(F.col("t") >= p.train_end)
    unk = lambda df: df.agg(metrics.share(F.col("x") == 0)).first()[0]
    top = metrics.histogram(train, "x").agg(F.max("p")).first()[0]
    kl = metrics.divergence(test, train, "x").first()["kl"]
    row = {"gran": p.gran, "k": p.k, "n": p.n, "train_end": p.train_end, "train_unk_rate": unk(train), "test_unk_rate": unk(test), "top1_share": top, "freq_kl": kl}
    return rows_frame(p.stream.sparkSession, [row], STATS_DDL)


def family(p: Prepared, lag: int, orders: int, stream: DataFrame | None = None) -> DataFrame:
    """A scorecard per order at one lag: alphas from the end of the training side, all orders off one table set.

    The stream is read once: positions are counted by context, symbol and what they serve for."""
    rows, t, marks = contexts(p.packed if stream is None else stream, orders, lag), F.col("t"), ngram.alpha_marks(p.train_end, orders, lag)
    test = eval_positions(t, p.train_end, p.n, lag, max(orders - 1, 1), STEPS)
    with scratch():
        grams = stored(ngram.counted(rows, orders, marks | {"train": ngram.fit_filter(t, 0, p.train_end, lag, orders), "test": test}), "grams")
        part = lambda mark: grams.where(mark).drop("fit", "held", "train", "test")
        alphas = {r["order"]: r["alpha"] for r in ngram.alpha_choice(ngram.alpha_bits_of(part("fit"), part("held"), p.k, orders)).collect()}
        alphas = {n: alphas.get(n, ngram.ALPHAS[0]) for n in range(1, orders + 1)}
        # the alpha of order n smooths every level of order n's model, so each order is scored with its own
        rows = []
        for same in sorted(set(alphas.values())):
            cards = ngram.scorecards(part("train"), part("test"), p.k, orders, dict.fromkeys(range(1, orders + 1), same), only=[n for n in alphas if alphas[n] == same])
            rows += [r.asDict() | {"alpha": same} for r in cards.collect()]
    rows.sort(key=lambda r: r["order"])
    unigram = rows[0]["bps"]
    return rows_frame(p.stream.sparkSession, [r | {"gran": p.gran, "k": p.k, "lag": lag, "unigram_bps": unigram} for r in rows], CARD_DDL)


def run(spark: SparkSession, texts: DataFrame, id_col: str, text_col: str, grans=("byte", "word"), ks=(16,), lags=(1,), orders: int = 3) -> DataFrame:
    """Scorecards over the sweep; lags of a window's length or more are skipped."""
    out = None
    for gran in grans:
        raw = symbols(texts, id_col, text_col, gran)
        for k in ks:
            p = prepare(raw, gran, k)
            for lag in lags:
                if lag >= STEPS:
                    continue
                cards = family(p, lag, orders)
                out = cards if out is None else out.unionByName(cards)
    return out


def leak_control(p: Prepared, lag: int, orders: int, seed: int = 0) -> DataFrame:
    """(margin, passes) on the shuffled stream."""
    mixed = stored(generators.shuffled(p.stream, seed), "shuffled")
    return verdict.leak_control(family(p, lag, orders, mixed).where(F.col("order") > 1))


def bar(cards: DataFrame) -> DataFrame:
    """(worst_gain, authorised) over the cells of a sweep, orders above the unigram."""
    return verdict.authorisation(cards.where(F.col("order") > 1), ["gran", "k", "lag"])


def report(spark: SparkSession, texts: DataFrame, id_col: str, text_col: str, grans=("byte", "word"), ks=(16, 64), lags=(1, 2, 4, 8, 16), orders: int = 4, sanity: bool = True, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """(cards of the sweep, verdict lines): S0, no model beats the unigram on any shuffled stream; S1, the bar over all cells."""
    cards, lines = run(spark, texts, id_col, text_col, grans, ks, lags, orders), []
    cards = stored(cards, "sweep")
    if sanity:
        for gran in grans:
            raw = symbols(texts, id_col, text_col, gran)
            for k in ks:
                p = prepare(raw, gran, k)
                for lag in (x for x in lags if x < STEPS):
                    row = leak_control(p, lag, orders, seed).first()
                    lines.append(f"S0 {gran} k={k} lag={lag}: {'PASS' if row['passes'] else 'FAIL'}, margin {row['margin']:+.4f} bits over the unigram on the shuffled stream")
    row = bar(cards).first()
    lines.append(f"S1: {'AUTHORISED' if row['authorised'] else 'NOT AUTHORISED'}, the worst cell gains {row['worst_gain']:.4f} bits over its unigram")
    return cards, lines


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--documents", required=True)
    parser.add_argument("--gran", default="byte,word")
    parser.add_argument("--k", default="16,64")
    parser.add_argument("--lag", default="1,2,4,8,16")
    parser.add_argument("--orders", type=int, default=4)
    parser.add_argument("--sanity", action="store_true", help="leak control on shuffled streams, cell by cell")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    numbers = lambda text: tuple(map(int, text.split(",")))
    cards, lines = report(spark, spark.read.parquet(args.documents), "doc_id", "text", tuple(args.gran.split(",")), numbers(args.k), numbers(args.lag), args.orders, args.sanity)
    cards.show(500, truncate=False)
    print("\n".join(lines))


if __name__ == "__main__":
    main()
