"""The training-data operators on small fixtures: brute force, exact round trips, and the defined edge cases."""

import base64
import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscope.llm import blob_ledger, chat_trie, common, components, contamination, line_dedup, near_dup, packing, toxicity, url_reputation, voronoi_knn, warc
from pairscope.llm.queries import QUERIES, URL_RULES, tokenizer_file

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_lines string, pos int, key string"


def docs(spark, rows):
    """Documents with extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "kept?", 7, "k") for i, t in rows], DOCS)


LONG = "This is a line that is certainly longer than forty characters"


# ---- line dedup -----------------------------------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(common.BLANKS).translate(LOWER)
            if len(k) >= min_chars:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(common.BLANKS).translate(LOWER)) >= min_chars and len(held[k]) >= min_docs and i != max(held[k]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\n{'É' * 40}\nend {i % 3} " + "x" * 40) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, LONG + "\n" + LONG), (60, "a\n" * 3000 + LONG), (4, rows[4][1])]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "pos", "key", "n_lines", "n_dropped"]
    found = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect())
    assert found == brute_lines(rows)


def test_line_dedup_null_id_and_empty_table(spark):
    rows = [(None, LONG)] + [(i, LONG) for i in range(4)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {None: 1, 0: 1, 1: 1, 2: 1, 3: 0}
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_passes_clashing_names_through(spark):
    names = ["id", "tag", "pos", "a", "b", "drops", "lines", "id_", "docs", "home", "LINE", "__text", "__id", "__tag", "__lines", "n_dropped"]
    rows = [(i, LONG, *[f"{n}{i}" for n in names]) for i in range(6)]
    made = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    got = line_dedup.dedup_lines(made)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_dropped"]
    for r in got.collect():
        assert (r["text"], r["n_dropped"]) == ((LONG, 0) if r["doc_id"] == 5 else ("", 1))
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names[:-1])


# ---- URL reputation -------------------------------------------------------------------------------------------------


def test_urls_nulls_repeats_and_long(spark):
    long_url = "http://" + "h" * 5000 + ".com/" + "p" * 200_000
    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.com/y"), (2, long_url), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("id", F.lit(9)).withColumn("s", F.lit("z")).withColumn("verdict", F.lit("old"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "page_id long, good int")
    got = url_reputation.judge_urls(pages, labels)
    assert got.columns == ["page_id", "url", "id", "s", "host", "path", "rule", "verdict", "posterior_mean", "posterior_upper"]
    found = got.collect()
    assert len(found) == 5 and all(r["id"] == 9 and r["s"] == "z" and r["verdict"] in ("allow", "block") for r in found)
    assert [len(r["path"]) for r in found if r["page_id"] == 2] == [200_001]
    other = spark.createDataFrame([("a.b.my.id",)], "h string").select(url_reputation.domain_of(F.col("h"), ["my.id"]).alias("d")).first()
    assert other["d"] == "b.my.id"


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/17", "nothing", None, "x://h?p/q", "ftp://shop.COM/fr/", "http://b.com/de/#z", "http://org", "http://notexample.org/es/", "a://b://c/d", "http://example.com/fr"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(pages, none, URL_RULES).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4][:3] == ("h", "", None)
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][:3] == ("org", "", None) and got[8][2:] == ("org/", "allow")
    assert got[9][:2] == ("b:", "//c/d") and got[10][2] is None
    assert url_reputation.judge_urls(pages.where("false"), none, URL_RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages, labels, n = [], [], 0
    for host, count, rate in (("bad.one.com", 60, 0.05), ("few.one.com", 1, 0.0), ("one.page.net", 1, 0.0), ("good.two.com", 60, 0.95), ("x.two.com", 60, 0.9)):
        for k in range(count):
            pages.append((n, f"http://{host}/{k}"))
            labels.append((n, int(k >= count * (1 - rate))))
            n += 1
    labels += [(n + 1, None), (None, 1)]
    judged = url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"))
    by = {r["host"]: r for r in judged.dropDuplicates(["host"]).collect()}
    assert by["bad.one.com"]["verdict"] == "block" and by["good.two.com"]["verdict"] == "allow"
    assert by["few.one.com"]["posterior_mean"] < by["one.page.net"]["posterior_mean"] < by["good.two.com"]["posterior_mean"]
    # one page says little, but its domain is bad
    assert by["few.one.com"]["verdict"] == "block" and by["one.page.net"]["verdict"] == "allow"
    suffix = spark.createDataFrame([("a.b.co.uk",), ("b.org",)], "h string").select(url_reputation.domain_of(F.col("h")).alias("d"), url_reputation.suffix_of(F.col("h")).alias("s")).collect()
    assert [tuple(r) for r in suffix] == [("b.co.uk", "co.uk"), ("b.org", "org")]


# ---- blob ledger ----------------------------------------------------------------------------------------------------

ASSIGN = re.compile(blob_ledger.BASE[0].pattern)


def brute_spans(text):
    t = text or ""
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


TEXTS = [
    None, "", "x password=token:abcdefgh y", 'é API_KEY : "abcdef" apikey==zzzzzz', "token = secret=abcdefg ÿ😀 passwd:12345", "AKIA" + "A1" * 9 + " AKIAAKIA" + "B" * 16, "0123456789abcdef" * 2 + " deadbeef " + "f" * 24,
    "Secret='aaa' secret='aaaaaa'", "token " * 50 + "token:" + "a" * 30, "password=\npassword=abcdef12", "AKIA" + "0" * 15, "pass" + "word=ſecret1 TOKEN=\u212aabcdef",
]


def test_spans_equal_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100, TEXTS[3]), (101, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, 0, t, "x") for i, t in rows], "path long, version int, content string, blob string")
    ledger = blob_ledger.Ledger(spark)
    found = ledger.update(df)
    got = sorted((r["path"], r["s"]) for r in found.select("path", blob_ledger.spans_text(F.col("findings"), 3).alias("s")).collect())
    assert got == sorted((i, brute_spans(t)) for i, t in rows)
    assert ledger.entries().count() == len({t or "" for _, t in rows})


def test_ledger_skips_seen_blobs_and_scans_again_for_new_rules(spark):
    first = spark.createDataFrame([("a", 1, TEXTS[3]), ("b", 1, "clean")], "path string, version int, content string")
    ledger = blob_ledger.Ledger(spark)
    ledger.update(first)
    second = first.unionByName(spark.createDataFrame([("a", 2, TEXTS[6]), (None, None, TEXTS[6])], first.schema))
    found = {(r["path"], r["version"]): r["findings"] is not None for r in ledger.update(second).collect()}
    assert ledger.entries().count() == 3
    assert found == {("a", 1): True, ("a", 2): True, (None, None): True, ("b", 1): False}
    ledger.update(second)
    assert ledger.entries().count() == 3
    # a rule that changes under its name is another rule set
    changed = tuple(r._replace(pattern="clean") if r.kind == "pem" else r for r in blob_ledger.RULES)
    assert blob_ledger.version_of(changed) != blob_ledger.version_of(blob_ledger.RULES)
    found = {(r["path"], r["version"]): r["findings"] for r in ledger.update(second, changed).collect()}
    assert ledger.entries().count() == 6 and [f["kind"] for f in found["b", 1]] == ["pem"]
    assert ledger.update(second.where("false")).count() == 0


def test_spans_of_a_very_long_text(spark):
    text = "token = abcdefgh é " * 20_000 + "f" * 30
    df = spark.createDataFrame([(1, 0, text)], "path long, version int, content string")
    got = blob_ledger.Ledger(spark).update(df).select(blob_ledger.spans_text(F.col("findings"), 3).alias("s")).first()["s"]
    assert got == brute_spans(text)


# ---- WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>é\r\n\r\n</p>", None, "", "same", "same", "x" * 300_000, "WARC/1.1\r\nContent-Length: 5\r\n\r\n"]
    rows = [(10 + i, f"http://h/{i} \r\nx", h, "clash") for i, h in enumerate(html)] + [(None, None, "same", "c"), (13, "http://h/3", "same", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    index = warc.write_archives(pages)
    got = warc.read_records(index, index._folder, gap=10, span=1000).collect()
    assert len(got) == len(rows)
    smallest = {}
    for i, _, h, _ in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    for r in got:
        source = next(x for x in rows if x[0] == r["id"])
        body = (source[2] or "").encode()
        first = smallest[source[2] or ""]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["id"] else ("revisit", first))
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == body)
    assert warc.read_records(index, index._folder).rdd.getNumPartitions() > 1
    few = warc.read_records(index.where("id = 15"), index._folder).collect()
    assert len(few) == 1 and len(few[0]["payload"]) == 300_000
    big = warc.write_archives(pages, min_bytes=5)
    assert big.where("record_type = 'revisit'").count() == 0
    empty = warc.write_archives(pages.where("false"))
    assert empty.count() == 0 and warc.read_records(empty, empty._folder).count() == 0


# ---- packing --------------------------------------------------------------------------------------------------------


def slow_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_library():
    encode = packing.Encoder(tokenizer_file("byte_bpe_50k.json"), limit=5)
    hard = [
        "", " ", "  ", "a  b", "a   b", " lead", "trail ", "trail  ", "x\n y", "x\n  y", "x \n y", "a \t b", "don't  we'll I'M", "été 東京 😀 ﬁ", "a<|endoftext|> b", "\u00a0x \u2003y", "x\x1c y", "n \u0301e", "1234 5 67", "tab\there \n\n end\n", "ǅ ʰa ªb ²c",
    ]
    for text in hard + [" ".join(hard), ("word " * 60_000 + "é\n ") * 5]:
        assert encode(text) == struct.pack(f"<{len(i := slow_ids(text)[:-1])}I", *i), text[:40]


def test_packing_covers_every_id_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("word" + str(x) for x in rng.integers(0, 50, n))) for i, n in enumerate([0, 1, 5, 40, 200, 300, 511, 900, 1500, 3000] * 3)] + [(90, None), (91, ""), (5, "twice"), (5, "twice"), (None, "no id")]
    pieces = packing.pack_documents(docs(spark, rows).repartition(2), tokenizer_file("byte_bpe_50k.json"), flush_tokens=5000).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for i, t in rows:
        ids, got = slow_ids(t), sorted((p["start"], p["length"], bytes(p["ids"])) for p in by_doc[i])
        if i == 5 and len(got) != 1:
            continue
        assert b"".join(g[2] for g in got) == struct.pack(f"<{len(ids)}I", *ids)
    assert sum(p["length"] for p in pieces) == sum(len(slow_ids(t)) for _, t in rows)
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 2 * 1024
    assert packing.pack_documents(docs(spark, []), tokenizer_file("byte_bpe_50k.json")).where("doc_id is not null").count() == 0


def test_packing_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("tok" + str(x) for x in rng.integers(0, 90, n))) for i, n in enumerate([0, 1, 7, 60, 333, 700, 2500] * 4)] + [(90, None), (91, ""), (92, "é" * (1 << 20) + " end\n\n x")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_packing"](spark, str(tmp_path))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:7] == [(n, "bigint") for n in names]
    pieces, by_doc, sequences = got.collect(), collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(by_doc) == sorted(i for i, _ in rows)
    for i, t in rows:
        ids, at = slow_ids(t), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            part = ids[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024


# ---- near duplicates ------------------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets[i] = shingle_set(t, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.integers(0, 30)}" for w in words]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    rows, n = [], 0
    for family in range(6):
        base = [f"w{family}_{x}" for x in rng.integers(0, 400, 150)]
        for _ in range(25):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.05])))))
            n += 1
    rows += [(500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "Two\tWORDS"), (505, "two words "), (506, rows[0][1]), (507, "x " * 5000)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_components(docs(spark, rows), words=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_near_duplicates_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = docs(spark, [(3, text), (3, text), (7, text), (None, text), (8, None)])
    kept = near_dup.drop_near_duplicates(rows).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "3", "8", "None"]
    assert near_dup.near_components(docs(spark, [])).count() == 0


def test_near_duplicates_with_repeated_ids_do_not_depend_on_order(spark):
    """An id is one document: its texts are in one component, and a link of one of them is a link of the id."""
    base = {c: [f"{c}{i}" for i in range(60)] for c in "abcd"}
    near = lambda c: " ".join([*base[c][:-1], "other"])
    text = {c: " ".join(w) for c, w in base.items()}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["b"]), (3, text["a"]), (4, near("b")), (5, text["c"]), (6, text["d"]), (7, near("d")), (7, near("c")), (8, text["c"]), (1, text["a"]), (9, "x")]
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9}
    for order in (rows, rows[::-1]):
        got = near_dup.near_components(docs(spark, order).coalesce(1)).collect()
        assert len(got) == len(rows) and {r["id"]: r["component_id"] for r in got} == want and all(want[r["id"]] == r["component_id"] for r in got)


def test_near_duplicates_of_many_edited_copies(spark):
    """Copies of one text with so many edits that most are no links: the exact prefix join settles them."""
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.035))) for i in range(120)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_components(docs(spark, rows), words=5, percent=80).collect()}
    assert got == brute_components(rows, 5, 80)


def test_components_of_a_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (2000, 1999), (1999, 2000)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}, 1999: 1999, 2000: 1999}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- decontamination ------------------------------------------------------------------------------------------------


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"b{i}_{x}" for x in rng.integers(0, 30, n))) for i, n in enumerate([6, 9, 17, 33, 60, 64, 120, 5, 3])] + [(20, None), (21, ""), (22, "b1_1"), (None, "null item id of five words")]
    rows, n = [], 0
    for i, t in items:
        words = (t or "").split()
        for share in (0, 0.05, 0.3):
            noise = [f"n{x}" for x in rng.integers(0, 500, rng.choice([0, 10, 400, 3000]))]
            cut = rng.integers(0, len(noise) + 1)
            rows.append((n, " ".join(noise[:cut] + edited(rng, words, share) + noise[cut:]).upper()))
            n += 1
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for d, t in rows:
        for i, u in items:
            s = shingle_set(u, 5)
            if s and 100 * len(s & shingle_set(t, 5)) >= 80 * len(s):
                want[(d, i)] += 1
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in contamination.find_items(docs(spark, rows), bench).collect())
    assert got == want and len(want) > 10
    left = contamination.drop_contaminated(docs(spark, rows), bench)
    assert left.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in rows if not any(x == d for x, _ in want))
    assert contamination.find_items(docs(spark, []), bench).count() == 0
    assert contamination.find_items(docs(spark, rows), bench.where("false")).count() == 0


def test_contamination_recall_by_item_size(spark):
    """Items that stand whole in a document are found at every size, one-shingle items above all."""
    rng = np.random.default_rng(12)
    sizes = (1, 2, 3, 5, 8, 9, 20, 60, 200)
    items, rows = [], []
    for k, size in enumerate(sizes):
        for j in range(60):
            words = [f"v{x}" for x in rng.integers(0, 60, size + 4)]
            items.append((100 * k + j, " ".join(words)))
            noise = [f"v{x}" for x in rng.integers(0, 60, int(rng.integers(0, 1500)))]
            cut = int(rng.integers(0, len(noise) + 1))
            rows.append((100 * k + j, " ".join(noise[:cut] + words + noise[cut:])))
    found = {(r["doc_id"], r["item_id"]) for r in contamination.find_items(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, size in enumerate(sizes):
        assert sum((100 * k + j,) * 2 in found for j in range(60)) == 60, size


def test_contamination_of_a_very_long_text(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(14))
    long_text = " ".join(f"n{i % 7919} m{i % 104_729}" for i in range(600_000)) + " " + item
    got = contamination.find_items(docs(spark, [(1, long_text), (2, "n1 m1")]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in got] == [(1, 7, 1.0)]


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(5)], "item_id long, text string")
    rows = docs(spark, [(i, f"x y alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} z") for i in range(6)])
    assert sorted((r["doc_id"], r["item_id"]) for r in contamination.find_items(rows, items).collect()) == [(i, i) for i in range(5)]
    assert [r["doc_id"] for r in contamination.drop_contaminated(rows, items).collect()] == [5]


# ---- toxicity -------------------------------------------------------------------------------------------------------


def toxic_rows():
    rng = np.random.default_rng(4)
    bad = ["vile", "rotten", "scummy", "nasty", "foul", "gross"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 8 == 0
        words = [f"w{x}" for x in rng.integers(0, 900, 40)]
        if toxic:
            for _ in range(4):
                words[rng.integers(0, 40)] = str(rng.choice(bad)) + str(rng.choice(["", "ly", "est"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (1002, "VILE! rotten, scummiest"), (7, rows[7][1])]
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), lab)
    got = toxicity.score_documents(docs(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(by[i]["score"] >= 0.3) == (i % 8 == 0) for i in held]) > 0.97
    assert not set(held) & set(model.ids)
    assert by[1002]["score"] > 0.7 and by[1002]["evidence"][0]["label"] == 1 and by[1000]["score"] == by[1001]["score"] < 0.3
    assert all(r["evidence"] for r in got if r["doc_id"] not in (1000, 1001)) and len({r["score"] for r in got}) > 50
    kept = [r["doc_id"] for r in toxicity.drop_toxic(docs(spark, [*rows, (None, "w1 w2"), (None, None)]), model).collect()]
    assert 1002 not in kept and 1001 in kept and kept.count(None) == 2 and kept.count(7) == 2
    long_text = "w5 " * 400_000 + "vile " * 200_000 + "scummy rotten " * 100_000
    assert toxicity.score_documents(docs(spark, [(1, long_text)]), model).first()["score"] > 0.5
    assert toxicity.score_documents(docs(spark, []), model).count() == 0


def brute_toxicity(rows, labels):
    """Fit and scores from the definition with dense matrices: no index, no blocks, no tasks."""
    texts = {i: (t or "").encode() for i, t in rows}
    known = collections.defaultdict(int)
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = max(known[i], y)
    label = {i: y for i, y in known.items() if i in texts}

    def count(text):
        c = collections.Counter()
        for w in text.translate(toxicity.FOLD).split():
            c.update([w, *(w[:n] + b"*" for n in toxicity.PREFIXES if len(w) >= n)])
        return c

    counts = {i: count(t) for i, t in texts.items()}
    df = collections.Counter(t for i in label for t in counts[i])
    pos = collections.Counter(t for i in label if label[i] for t in counts[i])
    terms = sorted(t for t in df if df[t] >= 5 and toxicity.LEAST_SHARE <= df[t] / len(label) <= toxicity.MOST_SHARE)
    rate = sum(label.values()) / len(label)
    scale = np.zeros(len(terms))
    for k, t in enumerate(terms):
        idf = np.log((1 + len(rows)) / (1 + sum(t in count((x or "").encode()) for _, x in rows)))
        e = df[t] * rate
        scale[k] = idf * max(toxicity.FLOOR, min(1, abs(pos[t] - e) / np.sqrt(e * (1 - rate) + 1e-9) / toxicity.FULL_Z))
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    matrix = {i: unit(np.array([(1 + np.log(c[t])) * s if c[t] else 0.0 for t, s in zip(terms, scale)])) for i, c in counts.items()}
    prior = (sum(known.values()) + 0.1) / (len(known) + 1)
    order = sorted(label)
    dense, y = np.array([matrix[i] for i in order]), np.array([label[i] for i in order], float)

    def vote(v, skip=None):
        cosines = dense @ v
        near = [k for k in np.lexsort((np.arange(len(order)), -cosines.round(12))) if cosines[k] > 1e-12 and k != skip][: toxicity.NEIGHBOURS]
        if not near:
            return None
        w = 1 / (1.1 - cosines[near])
        return (w @ y[near] + prior) / (w.sum() + 1)

    votes = [vote(dense[k], k) for k in range(len(order))]
    empty = np.array([v is None for v in votes])
    none = (y[empty].sum() + prior) / (empty.sum() + 1)
    knots = toxicity.isotonic(np.array([v for v in votes if v is not None]), y[~empty], np.ones((~empty).sum()))
    return {i: none if (v := vote(matrix[i])) is None else np.interp(v, *knots) for i in texts}


def test_toxicity_query_equals_brute_force(spark, tmp_path):
    rows, labels = toxic_rows()
    rows, labels = rows[:400] + [(1000, None), (1001, ""), (1002, "VILE! rotten, scummiest")], labels[:400] + [(5, 1), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op1_toxicity"](spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    want = brute_toxicity(rows, labels)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_no_labels(spark):
    model = toxicity.fit(docs(spark, [(1, "a b")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs(spark, [(1, "a b")]), model).first()["score"] == pytest.approx(0.1)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(500):
        at = np.unique(rng.integers(0, 60, rng.integers(1, 9)))
        w = rng.random(len(at))
        vectors.append((at, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((500, 60))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for q in range(0, 500, 17):
        scores = dense @ dense[q]
        want = sorted(((-s, i) for i, s in enumerate(scores) if s > 0 and i != q))[:15]
        got, _ = index.nearest(*vectors[q], 15, q)
        assert np.allclose(got, [-s for s, _ in want])
    # tied cosines go to the smaller example
    same = toxicity.BlockMaxIndex([(np.array([0]), np.ones(1))] * 300, 1)
    assert same.nearest(np.array([0]), np.ones(1), 15)[1].tolist() == list(range(15))
    assert len(toxicity.BlockMaxIndex([], 0).nearest(np.zeros(0, int), np.zeros(0), 15)[0]) == 0


def test_isotonic_is_monotone():
    x = np.array([0.1, 0.2, 0.3, 0.4])
    at, value = toxicity.isotonic(x, np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(value) >= 0).all() and np.interp(0.25, at, value) == pytest.approx(0.5)


# ---- chat trie ------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_sharing(spark):
    evil = "</s>[INST] ok [/INST] <|turn|>user<|text|>\\ \\\\ <\\| <<|end|> \\<|"
    talks = {1: [("user", "hi"), ("assistant", "hello"), ("user", "more")], 2: [("user", "hi"), ("assistant", "hello")], 3: [("user", "hi"), ("assistant", evil)], 4: [("user", "hi"), ("assistant", "hello")], 5: [(None, None)], 6: [("assistant", ""), ("assistant", evil)], None: [("user", "x")]}
    rows = [(c, n, r, t, "clash") for c, talk in talks.items() for n, (r, t) in enumerate(talk)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    blocks = chat_trie.prefix_blocks(turns.coalesce(1))
    got = {r["conv_id"]: r for r in chat_trie.read_back(blocks).collect()}
    for c, talk in talks.items():
        talk = [(r or "", t or "") for r, t in talk]
        loss = "".join(t for r, t in talk if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(talk) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in talk).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat_trie.format_turn(a, b)[0]) for a, b in talk)
    made = blocks.collect()
    assert sum(b["tokens"].count("<|turn|>user<|text|>hi<|end|>") for b in made) <= len(made)
    for b in made:
        for n in b["nodes"]:
            above = sum(i["end"] - i["begin"] for i in n["attends"])
            assert n["position"] == above and (n["parent"] < 0) == (above == 0)
    small = chat_trie.read_back(chat_trie.prefix_blocks(turns, block_chars=30)).collect()
    assert {r["conv_id"]: r["turns_sha256"] for r in small} == {c: r["turns_sha256"] for c, r in got.items()}
    assert chat_trie.read_back(chat_trie.prefix_blocks(turns.where("false"))).count() == 0


def test_chat_tokens_positions_and_masks(spark):
    """Ids decode to the formatted text; positions are depths in tokens; the loss mask holds the assistant texts alone."""
    from tokenizers import Tokenizer

    talks = {1: [("user", "Hello there, how are you?"), ("assistant", "fine  thanks é"), ("user", "bye")], 2: [("user", "Hello there, how are you?"), ("assistant", "not so well </s>")], 3: [("user", "Hello there, how are you?"), ("assistant", "")], 4: [("assistant", "x" * 3000)]}
    turns = spark.createDataFrame([(c, n, r, t) for c, talk in talks.items() for n, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string")
    made = chat_trie.tokenised(chat_trie.prefix_blocks(turns.coalesce(1)), tokenizer_file("byte_bpe_50k.json")).collect()
    decode = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")).decode
    seen, shared = {}, 0
    for block in made:
        ids, nodes = block["ids"], block["nodes"]
        assert nodes[-1]["end"] == len(ids)
        shared += sum(decode(ids[n["begin"] : n["end"]]).count("Hello there") for n in nodes)
        for n in nodes:
            assert n["position"] == sum(i["end"] - i["begin"] for i in n["attends"])
        for leaf in block["leaves"]:
            chain, at = [], leaf["node"]
            while at >= 0:
                chain.insert(0, nodes[at])
                at = nodes[at]["parent"]
            path = [i for a in [*chain[-1]["attends"], chain[-1]] for i in ids[a["begin"] : a["end"]]]
            loss = "".join(chat_trie.unescape(decode(ids[n["loss_begin"] : n["loss_end"]])) for n in chain)
            seen[leaf["conv_id"]] = (chat_trie.parse_turns(decode(path, skip_special_tokens=False)), loss)
    assert shared <= len(made)
    assert seen == {c: (talk, "".join(t for r, t in talk if r == "assistant")) for c, talk in talks.items()}


def test_chat_of_one_very_long_conversation(spark):
    rows = [(1, n, "user" if n % 2 else "assistant", f"turn {n} " * 20) for n in range(4000)] + [(2, 0, "user", "y" * 3_000_000), (None, 0, "user", "a"), (None, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_trie.read_back(chat_trie.prefix_blocks(turns)).collect()}
    assert got[1]["n_turns"] == 4000 and got[1]["loss_chars"] == sum(len(r[3]) for r in rows[:4000:2])
    assert got[2]["formatted_chars"] > 3_000_000 and got[None]["n_turns"] == 2


def test_escape_is_reversible_and_breaks_controls():
    rng = np.random.default_rng(8)
    parts = [*chat_trie.CONTROL, "\\", "<", "|", ">", "s", "a", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 8)))
        written = chat_trie.escape(text)
        assert chat_trie.unescape(written) == text
        assert not any(c in written for c in chat_trie.CONTROL)


# ---- top-k ----------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(700, 8)).round(2)
    vectors[100:350] = vectors[100]
    vectors[350:360] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None] * 4), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, []), (1250, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi_knn.top_inner_products(table, table.where("vec_id % 50 = 0"), pivots=8).collect()}
    q = np.floor(vectors * 256).astype(int)
    want = {}
    for i in range(0, 700, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:5]
        want |= {(i, r + 1): (int(j), int(s[j])) for r, j in enumerate(order)}
    assert got == want
    few = table.where("vec_id < 3")
    assert voronoi_knn.top_inner_products(few, few).count() == 6
    assert voronoi_knn.top_inner_products(few.where("false"), few.where("false")).count() == 0


def brute_top(rows, ids, k=5):
    vectors = {j: np.floor(np.array(v, float) * 256).astype(np.int64).astype(object) for j, (_, v) in enumerate(rows)}
    limit = lambda x: max(-(2**63), min(2**63 - 1, int(x)))
    out = []
    for j, (i, _) in enumerate(rows):
        if i in ids:
            scores = sorted((-limit(vectors[j] @ vectors[m]), rows[m][0]) for m in vectors if rows[m][0] != i)[:k]
            out += [(i, r + 1, v, -s) for r, (s, v) in enumerate(scores)]
    return sorted(out)


def visited_share(spark, table, queries, k=5):
    data = common.stored(voronoi_knn.quantised(table, "vec_id", "embedding", 256), "data")
    asked = voronoi_knn.quantised(queries, "vec_id", "embedding", 256)
    _, cells = voronoi_knn.cells_of(data, k, None)
    rows = dict(zip(cells.cells.tolist(), cells.rows.tolist()))
    visits = [r["cells"] for r in voronoi_knn.routed(asked, cells, k).collect()]
    return sum(rows[c] for v in visits for c in v) / (len(visits) * sum(rows.values()))


def test_top_k_leaves_cells_out_on_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).round(3).tolist()) for i in range(3000)]
    # one id that repeats sixty times is a query too
    rows += [(50, (centres[7] + 0.01 * rng.normal(size=16)).round(3).tolist()) for _ in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 50 = 0")
    share = visited_share(spark, table, asked)
    print("visited share on clustered vectors", share)
    assert share < 0.5
    got = sorted(tuple(r) for r in voronoi_knn.top_inner_products(table, asked).collect())
    assert got == brute_top(rows, set(range(0, 3000, 50)))


def test_top_k_saturates_beyond_64_bits(spark):
    rows = [(0, [3e8, 1e8]), (1, [1e8, 1e8]), (2, [-3e8, -1e8]), (3, [1e300, -1e300]), (4, [0.5, 0.25]), (5, [2e8, 2e8]), (50, [1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi_knn.top_inner_products(table, table.where("vec_id % 50 = 0")).collect()}
    most = 2**63 - 1
    assert [got[0, r] for r in (1, 2, 3, 4, 5)] == [(1, most), (3, most), (5, most), (50, most), (4, 128 * 3 * 256 * 10**8 + 64 * 256 * 10**8)]
    assert [got[50, r] for r in (1, 2, 3, 4, 5)] == [(0, most), (1, most), (3, most), (4, most), (5, most)]


def test_top_k_of_very_wide_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3000).round(2).tolist()) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in voronoi_knn.top_inner_products(table, table.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows, {0})
