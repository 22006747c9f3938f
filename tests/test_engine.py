"""Operators against small NumPy re-derivations, and the statistical behaviour of the pipelines."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscope.functions import metrics
from pairscope.operators import criterion, encode, lags, logistic, lowrank, ngram, nulls, readout, split, suffstats, verdict
from pairscope.operators.candidates import pool, ranked
from pairscope.plans import cells, modes, ngram_program, run_mode
from pairscope.plans.detect import detect
from pairscope.sources import generators, tables, tokens
from pairscope.streaming.criterion import windowed_cells


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, int(a), int(b), int(c), float(e)) for i, (a, b, c, e) in enumerate(zip(rng.integers(0, 4, 600), rng.integers(0, 3, 600), rng.integers(0, 5, 600), rng.normal(0.3, 1, 600)))]
    return spark.createDataFrame(data, "id long, a int, b int, c int, err double"), data


def dense_score(data, i, j, weighted):
    err = np.array([r[4] for r in data])
    cell = {}
    for r, e in zip(data, err):
        s = cell.setdefault((r[i], r[j]), [0, 0.0])
        s[0] += 1
        s[1] += e
    return sum((s - n / len(data) * err.sum()) ** 2 / (n if weighted else 1) for n, s in cell.values())


@pytest.mark.parametrize("weighted", [True, False])
def test_criterion_is_the_centred_block(rows, weighted):
    df, data = rows
    got = {(r["i"], r["j"]): r["score"] for r in criterion.pair_scores(df, ["a", "b", "c"], "err", weighted).collect()}
    for i, j in got:
        assert got[i, j] == pytest.approx(dense_score(data, i + 1, j + 1, weighted), rel=1e-9)


def test_centring_matters(rows):
    df, data = rows
    raw = df.groupBy("a", "b").agg(F.sum("err").alias("s")).agg(F.sum(F.col("s") ** 2)).first()[0]
    assert abs(raw - dense_score(data, 1, 2, False)) > 1


def test_null_values_are_a_cell_of_their_own(spark):
    df = spark.createDataFrame([("x", None, 1.0), ("x", "q", -1.0), (None, None, 2.0)], "a string, b string, err double")
    assert criterion.pair_cells(df, ["a", "b"], ["err"]).count() == 3
    codes = {r["a"]: r["code"] for r in encode.dictionary(df, "a").collect()}
    assert codes == {"x": 0, None: 1}
    assert encode.encode(df, ["a", "b"]).count() == 3


def test_lags_equal_joins_across_chunks(spark):
    s = generators.single_interaction(spark, 500, 7, 3, 1).select("t", "x")
    halo = lags.with_lags(s, [0, 2, 5], chunk=37)
    assert halo.count() == 500
    joined = halo.join(lags.lag_join(s, 5), "t")
    assert joined.count() == 495 and joined.where("x5 <> lagged").count() == 0
    assert halo.where("x5 is null").count() == 5


def test_gram_from_counts(rows):
    df, data = rows
    t = suffstats.Tables(df, ["a", "b", "c"], [4, 3, 5])
    x = np.hstack([np.eye(k)[[r[i] for r in data]] for i, k in ((1, 4), (2, 3), (3, 5))])
    assert np.allclose(t.full, x.T @ x)
    with pytest.raises(ValueError, match="SKIPPED"):
        suffstats.Tables(df, ["a"], [4], budget=3)


def test_readout_equals_dense_solve(rows):
    df, data = rows
    model = readout.fit_readout(df, ["a", "b"], [4, 3], "c", 5, F.col("id"), 600)
    x = np.hstack([np.eye(4)[[r[1] for r in data]], np.eye(3)[[r[2] for r in data]], np.ones((600, 1))])
    t = np.eye(5)[[r[3] for r in data]] - 0.2
    g = x[:420].T @ x[:420] + 1e-2 * np.eye(8)
    g[-1, -1] += 1e6
    w = np.linalg.solve(g, x[:420].T @ t[:420])
    got = model.logits([np.array([r[1] for r in data]), np.array([r[2] for r in data])])
    assert np.allclose(got, x @ w, atol=1e-9)
    p = readout.softmax(got / model.temperature)
    want = -np.log2(p[np.arange(600), [r[3] for r in data]]).mean()
    assert readout.score(df, model, "c").first()["bits"] == pytest.approx(want, abs=1e-9)


def test_low_rank_steps_from_counts():
    rng = np.random.default_rng(0)
    k, dim, c, n = 4, 3, 2, 300
    a, b = rng.integers(0, k, n), rng.integers(0, k, n)
    t = rng.normal(size=(n, c))
    q, r, old = rng.normal(size=(k, dim)), rng.normal(size=(dim, c)), rng.normal(size=(k, dim))
    n_ab, s_ab = np.zeros((k, k)), np.zeros((k, k, c))
    np.add.at(n_ab, (a, b), 1)
    np.add.at(s_ab, (a, b), t)
    got = lowrank.factor_step(n_ab, s_ab, q, r, old, 1e-3)
    for s in range(k):
        z = np.concatenate([(q[bb] * r.T) for bb in b[a == s]])
        want = np.linalg.solve(z.T @ z + 1e-3 * np.eye(dim), z.T @ t[a == s].ravel())
        assert np.allclose(got[s], want, atol=1e-9)


def test_true_lag_is_first_and_block_solves_it(spark):
    row = modes.demo(spark, K=4, samples=2000, n_cand=6, W=5, k=3, draws=3).first()
    assert row["rank"] == 1 and row["pick"] == 3
    assert abs(row["base_bits"] - 2) < 0.05 and row["pick_bits"] < 0.05 and row["wrong_bits"] > 1.9
    assert row["pick_z"] > 10


def test_additive_stream_has_no_bits_left(spark):
    d = cells.stream_design(generators.additive_stream(spark, 20_000, 4, 1), 20_000, 4, 4, 4, 4)
    assert cells.numbers(readout.score(d.test, cells.fit_additive(d)))["bits"] < 0.05


def test_no_pair_block_solves_a_sum_of_three(spark):
    d = cells.stream_design(generators.multi_sum(spark, 30_000, 4, [0, 1, 2], 3), 30_000, 4, 4, 4, 4)
    assert cells.exact_block(d, [("x0", "x1")])["bits"] > 1.9
    with pytest.raises(ValueError):
        generators.multi_sum(spark, 10, 4, [1, 1], 3)


def test_weighting_keeps_the_first_on_uniform_streams(spark):
    d = cells.stream_design(generators.components_stream(spark, 40_000, 8, [(1, 2)], 2, 1), 40_000, 8, 2, 5, 5)
    base = cells.fit_additive(d)
    tops = {cells.top(cells.residual_scores(d, base, d.slots, weighted=w)) for w in (True, False)}
    assert tops == {(1, 2)}


def test_emitted_table_is_the_rule(spark):
    acc = modes.table_accuracy(modes.emit(spark, K=6, samples=3000)).first()
    assert acc["exact"] == 1 and acc["weighted"] == 1


def test_detect_finds_a_planted_pair_and_nothing_else(spark):
    rng = np.random.default_rng(1)
    made = [(i, f"a{x}", f"b{y}", f"c{z}" if z else None, int((x + y) % 2 if u < 0.9 else u < 0.95), int(u * 1e6) % 2) for i, (x, y, z, u) in enumerate(zip(rng.integers(0, 4, 3000), rng.integers(0, 4, 3000), rng.integers(0, 3, 3000), rng.random(3000)))]
    df = spark.createDataFrame(made, "id int, fa string, fb string, fc string, good int, coin int")
    found = detect(df, "good", id_col="id", draws=10)
    s = found.summary.first()
    assert (s["pick_a"], s["pick_b"], s["verdict"]) == ("fa", "fb", "clears_null") and s["gain"] > 0.3
    assert found.cells.count() == 8
    assert detect(df, "coin", "fa,fb,fc", id_col="id", draws=10).summary.first()["verdict"] != "clears_null"
    with pytest.raises(ValueError):
        detect(df, "good", "fa,nothing")
    with pytest.raises(Exception, match="must be 0 or 1"):
        tables.binary_target(df, "id").select("y").collect()


def test_grouped_newton_equals_mllib(spark):
    rows = [(i, i % 3, (i * 7) % 4, int((i % 3 + i * 7 % 4 + i % 5) % 2 == 0), "te" if i % 4 == 3 else "tr") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, a int, b int, y int, split string")
    ours = logistic.fit_logistic(df, ["a", "b"])
    assert isinstance(ours, logistic.GroupedLogistic)
    spread = logistic.SpreadLogistic(ours.frame, ["a", "b"])
    assert spread.additive_bits == pytest.approx(ours.additive_bits, abs=1e-5)
    assert spread.pair_bits(0, 1, 10) == pytest.approx(ours.pair_bits(0, 1, 10), abs=1e-4)
    assert ours.pair_bits(0, 1, 10_000) is None and spread.pair_bits(0, 1, 10_000) is None
    p = {(r["g0"], r["g1"]): r["p"] for r in spread.residual_frame(["g0", "g1"]).collect()}
    assert p == pytest.approx({(r["g0"], r["g1"]): r["p"] for r in ours.residual_frame(["g0", "g1"]).collect()}, abs=1e-4)


def test_detect_beyond_the_driver_bounds_gives_the_same_verdict(spark, monkeypatch):
    rows = [(i, f"a{i % 4}", f"b{i // 4 % 3}", f"c{i % 7}", int((i % 4 + i // 4 % 3) % 2 == (0 if i % 11 else 1))) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, fa string, fb string, fc string, good int")
    near = detect(df, "good", id_col="id", draws=3)
    monkeypatch.setattr(logistic, "MOST_GROUPS", 10)
    with pytest.raises(ValueError):
        logistic.GroupedLogistic(logistic.grouped(spark.createDataFrame([(i, 0, "tr") for i in range(20)], "a int, y int, split string"), ["a"]), ["a"])
    far = detect(df, "good", id_col="id", draws=3)
    a, b = near.summary.first(), far.summary.first()
    assert a["verdict"] == b["verdict"] == "clears_null" and (a["best_a"], a["best_b"]) == (b["best_a"], b["best_b"]) == ("fa", "fb")
    assert b["best_bits"] == pytest.approx(a["best_bits"], abs=1e-3) and b["additive_bits"] == pytest.approx(a["additive_bits"], abs=1e-3)
    monkeypatch.setattr(logistic, "MOST_GROUPS", 200_000)
    monkeypatch.setattr(logistic, "MOST_ENTRIES", 84 * 16)
    wide = detect(df, "good", id_col="id", draws=3).summary.first()
    assert wide["best_bits"] == pytest.approx(a["best_bits"], abs=1e-3)


def test_permutations_keep_values_and_change_places(rows):
    df, data = rows
    moved = nulls.permuted(df, "id", "err", 2, 1)
    assert moved.count() == 1200
    total = sum(r[4] for r in data)
    for r in moved.groupBy("draw").agg(F.sum("err").alias("s")).collect():
        assert r["s"] == pytest.approx(total)
    assert moved.join(df.withColumnRenamed("err", "old"), "id").where("err <> old").count() > 1000


def test_ranks_put_missing_last_and_break_ties(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 2, None), (1, 2, float("nan")), (0, 3, 2.0)], "i int, j int, score double")
    got = [(r["i"], r["j"]) for r in ranked(df).orderBy("rank").collect()]
    assert got[:2] == [(0, 1), (0, 3)]
    assert pool(45) == (10 + 1 - 1, [(a, b) for a in range(10) for b in range(a + 1, 10)])


def test_verdict_gates(spark):
    rows = spark.createDataFrame([(1.0, 1.01, 0.0), (1.0, 0.5, 0.0)], "bar double, additive double, oracle double")
    assert [r["valid"] for r in verdict.instrument_gates(rows, "bar", "additive", "oracle").collect()] == [True, False]
    leak = spark.createDataFrame([(2.0, 2.0), (1.9, 2.0)], "bps double, unigram_bps double")
    assert verdict.leak_control(leak).first()["passes"] is False
    gain = verdict.authorisation(spark.createDataFrame([("k", 1.5, 2.0), ("k", 1.9, 2.0), ("l", 1.9, 2.0)], "cell string, bps double, unigram_bps double"), ["cell"]).first()
    assert gain["worst_gain"] == pytest.approx(0.1) and not gain["authorised"]
    assert verdict.width_guard(128, 10) and not verdict.width_guard(8, 10)
    assert verdict.parameters("exact", 8, 2) == 130


def test_ngram_beats_unigram_on_structure_only(spark):
    s = spark.range(8000).select(F.col("id").alias("t"), (F.col("id") % 4).cast("int").alias("x"))
    test = split.eval_positions(F.col("t"), 7000, 8000, 1, 2)
    card = {r["order"]: r for r in ngram.evaluate(s, 4, 2, 1, (0, 7000), test, {1: 1.0, 2: 0.01}).collect()}
    assert card[1]["bps"] == pytest.approx(2, abs=0.01) and card[2]["bps"] < 0.01 and card[2]["acc"] == 1
    mixed = ngram.evaluate(generators.shuffled(s, 1), 4, 2, 1, (0, 7000), test, {1: 10.0, 2: 10.0}, with_accuracy=False)
    bps = {r["order"]: r["bps"] for r in mixed.collect()}
    assert bps[2] - bps[1] > -0.02


def test_pinned_corpus(spark, tmp_path):
    (tmp_path / "c").write_bytes(b"hello world")
    good = hashlib.sha256(b"hello").hexdigest()
    assert bytes(tables.pinned_corpus(spark, str(tmp_path / "c"), 5, good).first()["content"]) == b"hello"
    with pytest.raises(Exception, match="corpus changed"):
        tables.pinned_corpus(spark, str(tmp_path / "c"), 5, "0" * 64).collect()


def test_csv_and_field_rule(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,n,y\nu,v,1,0\nw,,2,1\n")
    df = tables.csv_table(spark, str(tmp_path / "t.csv"))
    assert tables.categorical_fields(df, "y") == ["a", "b"]
    assert tables.categorical_fields(df, "y", "a,n") == ["a", "n"]
    assert df.where("b is null").count() == 1


def test_words_keep_order_over_documents(spark):
    df = spark.createDataFrame([(2, "b2 c!"), (1, "a"), (3, "")], "id int, text string")
    got = [r["word"] for r in tokens.dense_tokens(df, "id", "text").orderBy("t").collect()]
    assert got == ["a", "b", "2", "c", "!"]


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5],)], "l array<double>")
    p = df.select(metrics.softmax(F.col("l")).alias("p")).first()["p"]
    e = np.exp([1.0, 2.0, 0.5])
    assert np.allclose(p, e / e.sum())
    zero = spark.createDataFrame([(0.0,)], "p double").agg(metrics.bits(F.col("p")).alias("b")).first()["b"]
    assert zero == pytest.approx(-math.log2(1e-12))


def test_streaming_cells_equal_batch(spark, data, tmp_path):
    events = tables.table(spark, data, "events").select("ts", "event_type", (F.col("user_id") % 3).alias("u"), F.col("value").alias("err"))
    batch = windowed_cells(events, "ts", ["event_type", "u"], "err", "6 hours")
    stream = spark.readStream.schema(events.schema).parquet(str(events.write.parquet(str(tmp_path / "in")) or tmp_path / "in"))
    q = windowed_cells(stream, "ts", ["event_type", "u"], "err", "6 hours").writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window"]["start"], r["a"], r["b"])
    got = sorted(((key(r), r["n"], round(r["S_0"], 6)) for r in spark.table("cells").collect()), key=repr)
    assert got == sorted(((key(r), r["n"], round(r["S_0"], 6)) for r in batch.collect()), key=repr)


def test_program_on_structured_and_shuffled_text(spark):
    texts = spark.createDataFrame([(i, "the cat sat on the mat and the dog ran " * 40) for i in range(20)], "doc_id long, text string")
    p = ngram_program.prepare(ngram_program.symbols(texts, "doc_id", "text", "word"), "word", 8)
    stats = ngram_program.statistics(p).first()
    assert p.n == 8000 and p.train_end == 7000 and stats["train_unk_rate"] == pytest.approx(0.1, abs=0.11)
    cards = ngram_program.family(p, 1, 3)
    assert ngram_program.bar(cards).first()["authorised"]
    assert ngram_program.leak_control(p, 1, 3).first()["passes"]


def test_sweep_grid(spark):
    assert run_mode.grid({"K": "4,8", "seed": "0", "noise": "0.5"}) == [{"K": 4, "seed": 0, "noise": 0.5}, {"K": 8, "seed": 0, "noise": 0.5}]
    rows = run_mode.sweep(spark, "envelope", {"K": "3,4", "samples": "1500", "n_cand": "5", "W": "5", "k": "2"}).collect()
    assert [r["K"] for r in rows] == [3, 4] and all(r["rank"] == 1 for r in rows)


def test_own_shuffle_null(rows):
    df, _ = rows
    got = nulls.own_shuffle_null(df, "id", ["a", "b", "c"], [(0, 1), (0, 2)], ["err"], 3, 1)
    assert got.count() == 6 and nulls.null_threshold(got).first()["threshold"] > 0


def test_skips_are_notes(spark):
    assert verdict.identifiable(10, 20).startswith("SKIPPED") and verdict.identifiable(30, 20) is None
    notes = {r["arm"]: r["note"] for r in modes.als(spark, K=12, samples=300, sweeps=2).collect()}
    assert notes["exact"].startswith("SKIPPED")
