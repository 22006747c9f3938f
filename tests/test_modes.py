"""The modes do their whole job: ranks over all pairs, one rule from samples to rows, every arm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscope.operators import nulls, readout, suffstats
from pairscope.plans import cells, cli, modes, ngram_program, registry, run_mode
from pairscope.sources import generators


def symbols(spark, n):
    return generators.single_interaction(spark, n, 4, 2, 3).select("t", "x")


@pytest.mark.parametrize("window, rank", [(4, 6), (14, None)])
def test_natural_ranks_the_pick_among_all_pairs(spark, monkeypatch, window, rank):
    asked = []

    def block(d, pairs, **options):
        asked.append(pairs[0])
        return {"bits": 2.0 if len(asked) == 1 else 1.0}, {}

    monkeypatch.setattr(cells, "top", lambda scores: (0, 1))
    monkeypatch.setattr(cells, "lowrank_block", block)
    row = modes.natural(spark, symbols(spark, 600), 600, 4, window=window, stride=3, n_rand=2).first()
    assert asked[0] == ("x1", "x2") and row["pick_bits"] == 2.0
    assert row["rank_by_bits"] == rank
    assert row["random_mean"] == 1.0 and row["frac_beaten"] == 0.0
    assert len(asked) == (6 if rank else 3)


def test_natural_rank_equals_a_count_over_all_fits(spark):
    n, window, stride = 3000, 4, 3
    stream = symbols(spark, n)
    row = modes.natural(spark, stream, n, 4, window=window, stride=stride, n_rand=1).first()
    lagged = modes.with_lags(stream, list(range(window + 1))).withColumn("y", F.col("x0"))
    rows = lagged.where(modes.strided(F.col("t"), window + 1, stride)).cache()
    ordinal, cut = F.floor((F.col("t") - window - 1) / stride), int(-(-(n - window - 1) // stride) * 0.7)
    d = cells.Design(rows.where(ordinal < cut), rows.where(ordinal >= cut), ordinal, cut, [f"x{j}" for j in range(1, window + 1)], 4, 4)
    bits = {(i, j): cells.lowrank_block(d, [(f"x{i}", f"x{j}")])[0]["bits"] for i in range(1, 5) for j in range(i + 1, 5)}
    pick = bits[row["pick_i"], row["pick_j"]]
    assert pick == pytest.approx(row["pick_bits"], abs=1e-9)
    assert row["rank_by_bits"] == 1 + sum(b < pick - 1e-12 for b in bits.values())


def test_training_rows_follow_samples_at_every_size(spark, monkeypatch):
    rows = {}

    class Enough(Exception):
        pass

    def design(stream, n, alphabet, classes, window, start, stride=7, slots=None, heads=()):
        rows[n] = -(-(n // 2 - max(start, window)) // stride)
        raise Enough

    monkeypatch.setattr(cells, "stream_design", design)
    sizes = [1_500, 4_900, 4_999, 5_000, 20_000]
    for samples in sizes:
        with pytest.raises(Enough):
            modes.run_cell(spark, K=4, n_cand=8, samples=samples, W=6, light=True)
    assert [n / s for n, s in zip(rows, sizes)] == [14] * len(sizes)
    assert all(abs(r - s) <= 2 for r, s in zip(rows.values(), sizes))


@pytest.fixture
def quick_opponents(monkeypatch):
    asked = []

    def opponent(d, kind, **options):
        asked.append(kind)
        return {"bits": 0.5, "acc": 0.5}

    monkeypatch.setattr(modes, "opponent", opponent)
    return asked


def test_tune_and_gbm_compare_with_the_own_pick(spark, data, quick_opponents):
    got = {r["kind"]: r for r in modes.gbm(spark, registry.document_words(spark, data), fields=4, K=8, limit=2_000).collect()}
    assert set(got) == {"additive", "ours", "gbt"}
    assert (got["ours"]["pick_i"], got["ours"]["pick_j"]) == (0, 3)
    assert got["ours"]["bits"] < got["additive"]["bits"]


@pytest.mark.parametrize("most", [200, 2])
def test_fields_ranks_by_bits_and_scores_its_table(spark, data, monkeypatch, quick_opponents, most):
    monkeypatch.setattr(modes, "MOST_FIELD_PAIRS", most)
    row = modes.fields_mode(spark, registry.document_words(spark, data), 4, 8, 2_000, n_rand=2).first()
    assert row["n_cand"] == 6 and row["table_weighted"] > 0.9 and 0 <= row["table_exact"] <= 1
    assert (row["rank_pick_bits"], row["rank_true_bits"]) == ((1, 1) if most == 200 else (None, None))
    assert row["frac_beaten"] == (None if most == 200 else 1.0)


def test_boosting_and_speed_have_every_arm(spark, quick_opponents):
    row = modes.boosting(spark, M=1, K=4, samples=600, W=4, extra=0).first()
    assert row["all_cross_bits"] < row["additive_bits"] and row["gbt_bits"] == row["fm_bits"] == 0.5
    arms = [r["arm"] for r in modes.speed(spark, K=4, samples=600).collect()]
    assert arms[-2:] == ["boosted trees", "factorisation machine"]
    assert quick_opponents == ["gbt", "fm", "gbt", "fm"]


def test_pool_gives_every_candidate_its_own_shuffle(spark, monkeypatch):
    kept, own = [], nulls.own_shuffle_null

    def kept_null(*args, **options):
        kept.append(own(*args, **options).cache())
        return kept[-1]

    monkeypatch.setattr(nulls, "own_shuffle_null", kept_null)
    row = modes.pool_mode(spark, N=3, K=4, samples=600, a=0, b=2, draws=2).first()
    assert kept[0].count() == 2 * 3
    assert row["threshold"] == pytest.approx(nulls.null_threshold(kept[0]).first()["threshold"])


def test_dense_products_equal_the_counts(spark):
    rows = symbols(spark, 500).selectExpr("cast(x as int) a", "cast(t % 3 as int) b", "cast((x + t) % 2 as int) y")
    gram, rhs = readout.dense_products(rows.repartition(3), ["a", "b"], [4, 3], "y", 2)
    made = suffstats.Tables(rows, ["a", "b", "y"], [4, 3, 2])
    assert np.allclose(gram, suffstats.gram_with_intercept(made, ["a", "b"])) and np.allclose(rhs, suffstats.target_products(made, ["a", "b"], "y"))


def test_wide_cells_are_skipped_rows(spark):
    row = modes.demo(spark, K=1024, samples=100, W=10).first()
    assert row["note"].startswith("SKIPPED: width") and row["bits" if "bits" in row else "base_bits"] is None
    assert run_mode.verdict_lines("demo", [row.asDict()]) == [row["note"]]


def test_verdict_lines_and_ngram_report(spark, tmp_path):
    lines = run_mode.verdict_lines("pool", [{"N": 15, "rank": 1, "clears": True}])
    assert lines == ["N=15: true pair ranked 1, pick clears the null of the best"]
    got = [r.asDict() for r in modes.emit(spark, K=4, samples=1500).collect()]
    assert run_mode.verdict_lines("emit", got) == ["emitted table: 1.0000 of its entries are the rule's"]
    texts = spark.createDataFrame([(i, "the cat sat on the mat " * 30) for i in range(12)], "doc_id long, text string")
    cards, said = ngram_program.report(spark, texts, "doc_id", "text", ("word",), (4,), (1, 30), 2)
    assert cards.count() == 2 and [x.split(":")[0] for x in said] == ["S0 word k=4 lag=1", "S1"]
    assert "PASS" in said[0] and said[1].startswith("S1: AUTHORISED")
    line = cli.verdict_line({"verdict": "inside_null", "best_a": "a", "best_b": "b", "gain": 0.01, "pick_score": 1.0, "threshold": 2.0})
    assert line.startswith("NOT SIGNIFICANT: a x b")
