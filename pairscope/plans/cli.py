"""python -m pairscope.plans.cli --csv FILE --target COLUMN: the table verdict of one file, printed."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.tables import csv_table
from .detect import detect


def verdict_line(s: dict) -> str:
    """The verdict in words, with the numbers that it rests on."""
    pair = f"{s['best_a']} x {s['best_b']}"
    if s["verdict"] == "no_pair_helps":
        return f"NO INTERACTION: the best pair ({pair}) changes held-out bits by {s['gain'] or 0.0:+.4f}; the additive model is enough"
    if s["verdict"] == "inside_null":
        return f"NOT SIGNIFICANT: {pair} gains {s['gain']:.4f} bits, but the best score {s['pick_score']:.4g} is within what permutation gives ({s['threshold']:.4g})"
    return f"INTERACTION: {pair} gains {s['gain']:.4f} bits and the best score {s['pick_score']:.4g} clears the permutation threshold {s['threshold']:.4g}"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--csv", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--fields", help="comma-separated; every string column by default")
    parser.add_argument("--min_cell", type=int, default=10)
    parser.add_argument("--null_draws", type=int, default=20)
    parser.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    found = detect(csv_table(spark, args.csv), args.target, args.fields, min_cell=args.min_cell, draws=args.null_draws, seed=args.seed)
    found.pairs.orderBy("score_rank").show(50, truncate=False)
    found.summary.show(truncate=False, vertical=True)
    found.cells.show(truncate=False)
    print(verdict_line(found.summary.first().asDict()))


if __name__ == "__main__":
    main()
