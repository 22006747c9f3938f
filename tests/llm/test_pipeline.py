"""Queries against their SQL, and the pipeline against a brute-force version of all its stages."""

import collections
import math
import struct

import corpus_pipeline
import numpy as np
import oracle
import pytest
from test_operators import brute_components, brute_lines, shingle_set, slow_ids

from pairscope.llm import oracles, queries, toxicity


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, data, name):
    assert oracle.differences(spark, data, queries.QUERIES[name], oracles.ORACLES[name]) == ""


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def brute_score(model, text):
    """All cosines, no index."""
    vectors = brute_score.vectors
    query = np.zeros(len(model.terms))
    at, w = toxicity.vector(*toxicity.TermCounts(model.terms).of((text or "").encode()), model.scale)
    query[at] = w
    cosines = vectors @ query
    near = sorted(((c, i) for i, c in enumerate(cosines) if c > 1e-12), key=lambda x: (-round(x[0], 9), x[1]))[: toxicity.NEIGHBOURS]
    vote = model.vote(np.array([c for c, _ in near]), np.array([i for _, i in near], int))
    return model.none if vote is None else float(np.interp(vote, *model.knots))


def test_pipeline_equals_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    model = toxicity.fit(table, spark.read.parquet(f"{data}/labels.parquet"))
    brute_score.vectors = np.zeros((len(model.ids), len(model.terms)))
    index = model.index
    for cell in range(index.blocks * index.terms):
        for k in range(index.start[cell], index.start[cell + 1]):
            brute_score.vectors[index.who[k], cell % index.terms] = index.weight[k]
    rows = [(i, t) for i, t in rows if brute_score(model, t) < 0.3]
    rows = [(i, t) for i, n, gone, t in brute_lines(rows) if not gone or gone < n]
    found = brute_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if found[i][1] == i]
    bench = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(s and len(s & shingle_set(t, 5)) >= math.ceil(0.8 * len(s)) for s in bench)]
    got = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, data).collect():
        got[p["doc_id"]].append((p["start"], bytes(p["ids"])))
    want = {i: struct.pack(f"<{len(ids := slow_ids(t))}I", *ids) for i, t in rows}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in got.items()} == want


def test_stages_keep_the_columns(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, data).schema.simpleString() == table.schema.simpleString()
        empty = table.where("false")
        assert stage(spark, empty, data).count() == 0


LONG_LINE = "a line of the licence that stands in many documents and is long enough to count"
CASES = [
    (1, "one two three four five six seven eight nine ten", "en"), (1, "one two three four five six seven eight nine ten", None), (2, "one two three four five six seven eight nine ten", "en"),
    (None, "words without an id of any kind in this text", "en"), (None, None, None), (3, None, "en"), (4, "", "en"), (5, " \n\t\n ", None), (6, "x", "en"), (7, "long text " * 150_000 + "end", "en"),
    *[(10 + i, f"{LONG_LINE}\nown words of document number {i} and nothing else {i * 7}", "en") for i in range(6)],
]


@pytest.mark.parametrize("at", range(4))
def test_stage_edge_cases(spark, data, at):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named as operators name theirs."""
    name, stage = corpus_pipeline.STAGES[at]
    clash = ["id", "tag", "pos", "key", "component_id", "n_shingles", "score", "label", "drops", "lines", "set", "x", "part"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    made = spark.createDataFrame([(i, t, lang, None, len(t or ""), *[f"{c}!" for c in clash]) for i, t, lang in CASES], schema)
    got = stage(spark, made, data)
    assert got.schema.simpleString() == made.schema.simpleString()
    rows = got.collect()
    assert all(r[c] == f"{c}!" for r in rows for c in clash)
    count = collections.Counter(r["doc_id"] for r in rows)
    want = collections.Counter(i for i, _, _ in CASES)
    if name == "MinHash near-dedup":
        del want[2]
    assert count == want
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert (7, CASES[9][1]) in texts and (None, CASES[3][1]) in texts
    if name == "line dedup":
        assert [LONG_LINE in t for i, t in sorted(x for x in texts if (x[0] or 0) >= 10)] == [False] * 5 + [True]
        assert (3, "") in texts and all(r["n_chars"] == len(r["text"]) for r in rows)
    else:
        assert (3, None) in texts and (4, "") in texts


def test_last_stage_edge_cases(spark, data):
    made = spark.createDataFrame([(i, t, lang, "clash") for i, t, lang in CASES], "doc_id long, text string, lang string, ids string")
    rows = corpus_pipeline.STAGES[-1][1](spark, made, data).collect()
    assert sum(r["length"] for r in rows) == sum(len(slow_ids(t)) for _, t, _ in CASES)
