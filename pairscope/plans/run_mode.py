"""python -m pairscope.plans.run_mode MODE [--key value ...]: run experiment modes over a grid; comma lists are swept."""

from __future__ import annotations

import argparse
import inspect
import itertools

from pyspark.sql import DataFrame, SparkSession

from . import modes

MODES = {
    "demo": modes.demo, "envelope": modes.demo, "vs-gbdt": modes.vs_gbdt, "vs-all": modes.vs_all, "boosting": modes.boosting, "boosting2": modes.boosting, "multi": modes.multi, "speed": modes.speed,
    "als": modes.als, "alsmulti": modes.alsmulti, "pool": modes.pool_mode, "emit": modes.emit, "real": modes.real, "natural": modes.natural, "fields": modes.fields_mode, "tune": modes.tune, "gbm": modes.gbm,
}


def value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def grid(options: dict[str, str]) -> list[dict]:
    """The cartesian product of comma lists."""
    lists = {k: [value(x) for x in v.split(",")] for k, v in options.items()}
    return [dict(zip(lists, row)) for row in itertools.product(*lists.values())]


def sweep(spark: SparkSession, mode: str, options: dict[str, str], **fixed) -> DataFrame:
    """One frame of result rows over the grid."""
    run, out = MODES[mode], None
    if mode == "envelope":
        run = lambda s, **o: modes.rows_frame(s, [modes.run_cell(s, light=True, **o)], modes.CELL_DDL)
    for row in grid(options):
        got = run(spark, **fixed, **row)
        out = got if out is None else out.unionByName(got)
    return out


def verdict_lines(mode: str, rows: list[dict]) -> list[str]:
    """What the rows of a mode say, derived from their numbers alone."""
    out = []
    done = [r for r in rows if not r.get("note")]
    out += [r["note"] for r in rows if r.get("note")]
    if mode in ("demo", "envelope") and done:
        out.append(f"true lag ranked first in {sum(r['rank'] == 1 for r in done)} of {len(done)} cells")
        out += [f"K={r['K']} n={r['samples']}: picked block at {r['pick_bits']:.4f} of {r['bar']:.2f} bits ({'recovered' if r['pick_bits'] < 0.05 * r['bar'] else 'not recovered'})" for r in done if r["pick_bits"] is not None]
        out += [f"pick {'clears' if r['pick_z'] > 2 else 'is inside'} its null, z = {r['pick_z']:.2f}" for r in done if r.get("pick_z") is not None]
    elif mode in ("vs-all", "vs-gbdt", "als", "speed") and done:
        scored = [r for r in done if r["bits"] is not None and not r["arm"].startswith("check")]
        if scored:
            best = min(scored, key=lambda r: r["bits"])
            out.append(f"best arm: {best['arm']} at {best['bits']:.4f} bits")
        out += [f"{r['arm']}: {r['bits']:.4f} bits, {'fit for comparison' if r['bits'] < 0.2 and r['acc'] > 0.95 else 'NOT fit for comparison'}" for r in done if r["arm"].startswith("check")]
    elif mode.startswith("boosting") and rows:
        last = max(rows, key=lambda r: r["round"])
        gates = abs(last["additive_bits"] - last["bar"]) <= 0.05 and last["oracle_bits"] is not None and last["oracle_bits"] <= 0.05
        out.append(f"{last['hits']} of {last['M']} interactions found, {last['bits']:.4f} bits against an oracle of {last['oracle_bits']}; instrument {'valid' if gates else 'NOT valid'}")
    elif mode in ("multi", "alsmulti"):
        out += [f"{r['hits']} of {r['M']} interactions found, {r['mean_bits']:.4f} bits per head" for r in rows]
    elif mode == "pool":
        out += [f"N={r['N']}: true pair ranked {r['rank']}, pick {'clears' if r['clears'] else 'does not clear'} the null of the best" for r in rows]
    elif mode == "emit" and rows:
        out.append(f"emitted table: {sum(r['g'] == r['truth'] for r in rows) / len(rows):.4f} of its entries are the rule's")
    elif mode == "real":
        out += [f"noise {r['noise']} rare {r['rare']}: rank {r['rank_equal']} by equal weight, {r['rank_weighted']} by counts" for r in rows]
    elif mode == "natural":
        out += [f"pick ({r['pick_i']}, {r['pick_j']}): rank {r['rank_by_bits'] or 'not computed'} by bits, gain {r['additive_bits'] - r['pick_bits']:.4f}" for r in rows]
    elif mode == "fields":
        out += [f"true pair ranked {r['rank']}, block gains {r['additive_bits'] - r['pick_bits']:.4f} bits" for r in done]
    elif mode in ("tune", "gbm") and rows:
        ours, others = [r for r in rows if r["kind"] == "ours"], [r for r in rows if r["kind"] not in ("ours", "additive")]
        if ours and others:
            out.append(f"ours {ours[0]['bits']:.4f} bits, best opponent {min(r['bits'] for r in others):.4f}")
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("mode", choices=sorted(MODES))
    known, rest = parser.parse_known_args(argv)
    options = {k.lstrip("-").replace("-", "_"): v for k, v in zip(rest[::2], rest[1::2])}
    spark = SparkSession.builder.getOrCreate()
    needed = [p.name for p in inspect.signature(MODES[known.mode]).parameters.values() if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and p.name != "spark"]
    fixed = {}
    if "words" in needed or "symbols" in needed:
        from ..sources import tokens

        texts = spark.read.parquet(options.pop("documents"))
        words = tokens.dense_tokens(texts, "doc_id", "text")
        if "words" in needed:
            fixed["words"] = words
        else:
            from .ngram_program import prepare, symbols

            p = prepare(symbols(texts, "doc_id", "text", options.pop("gran", "byte")), "byte", int(options["K"]))
            fixed |= {"symbols": p.packed, "n": p.n}
    rows = sweep(spark, known.mode, options, **fixed).collect()
    print("\n".join("  ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in rows))
    print("\n".join(verdict_lines(known.mode, [r.asDict() for r in rows])))


if __name__ == "__main__":
    main()
