"""Packed streams against rows, and what the n-gram program and mode real write beside the texts they read."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairscope.operators import lags, ngram, split
from pairscope.plans import modes, ngram_program, registry
from pairscope.sources import packed
from pairscope.sources.shared import shared_root

ODD = ["the cat", None, "", "a1b22 cc", "été naïve 日本 \U0001f600x́", " \t\n\r\x0b\x0c", "x y\x1cz\x85w v", "..,,", "9", "Zz zZ", "\x00\x7f_-"] + list("ab cd1.") * 20 + ["the cat sat 12 " * 30]


def cut(text, gran):
    if gran == "byte":
        return [bytes([b]) for b in (text or "").encode()]
    return [w.encode() for w in re.findall(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]", text or "", re.ASCII)]


def coded(texts, gran, k):
    symbols = [w for _, text in sorted(texts) for w in cut(text, gran)]
    end = 7 * len(symbols) // 8
    n, first = Counter(symbols[:end]), {}
    for t, w in enumerate(symbols):
        first.setdefault(w, t)
    vocabulary = sorted(n, key=lambda w: (-n[w], w if gran == "byte" else first[w]))[: k - 1]
    codes = {w: i for i, w in enumerate(vocabulary, 1)}
    return [codes.get(w, 0) for w in symbols], end


@pytest.mark.parametrize("gran,k,text_ids", [("byte", 8, False), ("word", 5, False), ("word", 300, True), ("byte", 256, True)])
def test_codes_of_odd_texts(spark, gran, k, text_ids):
    texts = list(zip([f"d{i:04}" if text_ids else i - 50 for i in range(len(ODD))], ODD))
    random.Random(k).shuffle(texts)
    df = spark.createDataFrame(texts, f"doc_id {'string' if text_ids else 'long'}, text string").repartition(5)
    p = ngram_program.prepare(ngram_program.symbols(df, "doc_id", "text", gran), gran, k)
    want, end = coded(texts, gran, k)
    assert (p.n, p.train_end) == (len(want), end)
    assert [tuple(r) for r in p.stream.orderBy("t").collect()] == list(enumerate(want))


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_lags_reach_over_short_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(packed, "CHUNK", chunk)
    monkeypatch.setattr(packed, "ROWS", 50)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    p = ngram_program.prepare(ngram_program.symbols(df, "doc_id", "text", "word"), "word", 6)
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    for back, start, stride in (([0, 3, 64], 0, 1), (list(range(11)), 11, 4), ([0, 70], 2, 3)):
        want = lags.with_lags(p.stream, back).where(split.strided(F.col("t"), start, stride)).select("t", *[f"x{j}" for j in back])
        assert [tuple(r) for r in packed.strided_lags(p.packed, back, start, stride).select(want.columns).orderBy("t").collect()] == [tuple(r) for r in want.orderBy("t").collect()]
    for order, lag in ((1, 1), (3, 1), (4, 23), (2, 70)):
        names = ["t", *[f"x{i}" for i in range(max(order - 1, 1))], "y"]
        got, want = (f(s, order, lag).where(F.col("t") >= order - 2).select(names) for f, s in ((packed.contexts, p.packed), (ngram.contexts, p.stream)))
        assert rows(got) == rows(want)


def test_family_is_the_same_on_packed_and_plain_streams(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcde") + rng.choice("xy") for _ in range(rng.randrange(60)))) for i in range(150)]
    p = ngram_program.prepare(ngram_program.symbols(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", "word"), "word", 8)
    for a, b in zip(ngram_program.family(p, 2, 3).collect(), ngram_program.family(p, 2, 3, p.stream).collect()):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True)
    test = split.eval_positions(F.col("t"), p.train_end, p.n, 2, 2)
    for row in ngram_program.family(p, 2, 3).collect():
        own = ngram.evaluate(p.stream, 8, 3, 2, (0, p.train_end), test, dict.fromkeys((1, 2, 3), row["alpha"])).where(F.col("order") == row["order"]).first()
        assert own["bps"] == pytest.approx(row["bps"]) and own["acc"] == pytest.approx(row["acc"]) and own["n"] == row["n"]


def test_real_is_the_same_on_packed_and_plain_streams(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abcdefg") for _ in range(rng.randrange(80)))) for i in range(200)]
    p = ngram_program.prepare(ngram_program.symbols(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", "byte"), "byte", 8)
    a, b = (modes.real(spark, s, p.n, 8, stride=3, rare=2).first().asDict() for s in (p.packed, p.stream))
    assert a == pytest.approx(b)


def test_no_texts(spark):
    p = ngram_program.prepare(ngram_program.symbols(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), "doc_id", "text", "word"), "word", 8)
    assert p.n == 0 and p.stream.count() == 0 and [r["n"] for r in ngram_program.family(p, 1, 2).collect()] == [0, 0]


@pytest.mark.parametrize("query", ["mode_real_bytes", "ngram_family"])
def test_writes_no_more_than_three_times_the_text(spark, tmp_path, query):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [(i, " ".join(rng.choices(words, k=400))) for i in range(1000)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_root(spark).removeprefix("file://").removeprefix("file:"))

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(f.stat().st_size for f in folder.rglob("*.parquet")) + spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    registry.QUERIES[query](spark, str(tmp_path)).collect()
    assert written() - before < 3 * sum(len(text) for _, text in texts)
