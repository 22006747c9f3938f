"""Registered queries of the interaction engine and the SQL that DuckDB runs against them.

Floats are rounded on both sides.  Symbol sequences are events.event_type by event_id, coded by sorted name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, metrics
from ..functions.hashing import sql_draw32
from ..operators import candidates, criterion, encode, lags, ngram, nulls, opponents, split, suffstats, verdict  # noqa: F401
from ..sources import generators, tokens
from ..sources.tables import table
from . import modes, ngram_program
from .detect import detect

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIELDS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- sources shared by the queries, and the same as SQL ------------------------------------------------------------


def line_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*FIELDS, (F.col("l_quantity") > 25).cast("int").alias("y"))
    return criterion.mean_residual(rows, F.col("y"))


LINES = f"""base as (select {', '.join(FIELDS)}, cast(l_quantity > 25 as int) y, avg(cast(l_quantity > 25 as int)) over () - cast(l_quantity > 25 as int) err from lineitem)"""


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 10).cast("int").alias("u"), (F.col("user_id") % 7).cast("int").alias("v"), (F.col("value") > 50).cast("int").alias("y"))
    return criterion.mean_residual(e, F.col("y"))


EVENTS = """base as (select event_id, event_type kind, cast(user_id % 10 as int) u, cast(user_id % 7 as int) v, cast(value > 50 as int) y,
 avg(cast(value > 50 as int)) over () - cast(value > 50 as int) err from events)"""


def symbol_stream(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("t"), "event_type")
    return encode.encode(e, ["event_type"]).select("t", F.col("event_type_code").cast("int").alias("x"))


STREAM = "stream as (select event_id t, cast(dense_rank() over (order by event_type) - 1 as int) x from events)"


def pair_sql(fields: list[str], err: str = "err", keys: str = "", weighted: bool = True, pairs: list[tuple[int, int]] | None = None, source: str = "base") -> str:
    """cells and scores CTEs over all pairs of fields."""
    pairs = pairs or [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    k, ks = (f"{keys}, ", keys) if keys else ("", "")
    part = f"partition by {k}i, j"
    cells = " union all ".join(f"select {k}{i} i, {j} j, cast({fields[i]} as varchar) a, cast({fields[j]} as varchar) b, count(*) n, sum({err}) s from {source} group by all" for i, j in pairs)
    r = "pow(s - n / nn * ss, 2)" + (" / n" if weighted else "")
    return f"""cells as ({cells}), centred as (select *, sum(n) over ({part}) nn, sum(s) over ({part}) ss from cells),
scores as (select {k}i, j, sum({r}) score from centred group by {k or ''}i, j)"""


def name_sql(fields: list[str], col: str) -> str:
    return "case " + col + " " + " ".join(f"when {k} then '{f}'" for k, f in enumerate(fields)) + " end"


# ---- criterion ------------------------------------------------------------------------------------------------------


@query(f"with {LINES}, {pair_sql(FIELDS)} select {name_sql(FIELDS, 'i')} field_a, {name_sql(FIELDS, 'j')} field_b, round(score, 6) score from scores")
def pair_scores(spark, d):
    return rounded(criterion.named(criterion.pair_scores(line_items(spark, d), FIELDS), FIELDS).select("field_a", "field_b", "score"), "score")


@query(f"with {LINES}, {pair_sql(FIELDS, weighted=False)} select {name_sql(FIELDS, 'i')} field_a, {name_sql(FIELDS, 'j')} field_b, round(score, 3) score from scores")
def pair_scores_unweighted(spark, d):
    return rounded(criterion.named(criterion.pair_scores(line_items(spark, d), FIELDS, weighted=False), FIELDS).select("field_a", "field_b", "score"), "score", digits=3)


@query(f"with {LINES}, {pair_sql(FIELDS)} select cast(i as int) i, cast(j as int) j, round(score, 6) score from scores order by score desc, i, j limit 1")
def pair_pick(spark, d):
    return rounded(candidates.pick(criterion.pair_scores(line_items(spark, d), FIELDS)), "score")


@query(f"with {LINES}, {pair_sql(FIELDS)} select cast(i as int) i, cast(j as int) j, row_number() over (order by score desc, i, j) \"rank\" from scores")
def pair_rank(spark, d):
    return candidates.ranked(criterion.pair_scores(line_items(spark, d), FIELDS)).select("i", "j", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {LINES}, m as (select avg(y) m from base), ma as (select l_returnflag ra, avg(y) ma from base group by 1), mb as (select l_linenumber rb, avg(y) mb from base group by 1),
base2 as (select l_returnflag, l_linenumber, ma + mb - m - y err from base, m, ma, mb where ra = l_returnflag and rb = l_linenumber),
{pair_sql(['l_returnflag', 'l_linenumber'], source='base2')} select cast(i as int) i, cast(j as int) j, round(score, 6) score from scores"""
)
def main_effects_scores(spark, d):
    rows = criterion.main_effects_residual(line_items(spark, d).drop("err"), "l_returnflag", "l_linenumber", F.col("y"))
    return rounded(criterion.pair_scores(rows, ["l_returnflag", "l_linenumber"]), "score")


@query(
    f"""with {EVENTS}, two as (select *, avg(u) over () - u err2 from base), c as (select kind, v, count(*) n, sum(err) s, sum(err2) s2 from two group by 1, 2),
t as (select *, sum(n) over () nn, sum(s) over () ss, sum(s2) over () ss2 from c)
select 0 i, 1 j, round(sum((pow(s - n / nn * ss, 2) + pow(s2 - n / nn * ss2, 2)) / n), 5) score from t"""
)
def multi_head_scores(spark, d):
    rows = criterion.mean_residual(event_rows(spark, d), F.col("u"), "err2")
    return rounded(criterion.pair_scores(rows, ["kind", "v"], ["err", "err2"]), "score", digits=5)


@query(
    f"""with {STREAM}, y as (select event_id t, avg(cast(value > 50 as int)) over () - cast(value > 50 as int) err from events),
c as (select g.j j, a.x a, b.x b, count(*) n, sum(err) s from stream a join (select unnest(range(1, 9)) j) g on true join stream b on b.t = a.t - g.j join y on y.t = a.t group by 1, 2, 3),
k as (select *, sum(n) over (partition by j) nn, sum(s) over (partition by j) ss from c) select cast(j as int) "lag", round(sum(pow(s - n / nn * ss, 2)), 4) score from k group by j"""
)
def lag_pair_scores(spark, d):
    rows = lags.with_lags(symbol_stream(spark, d), list(range(9))).join(event_rows(spark, d).select(F.col("event_id").alias("t"), "err"), "t")
    scores = criterion.lag_scores(rows, list(range(1, 9)), ["err"])
    return rounded(scores.select(F.col("j").alias("lag"), "score"), "score", digits=4)


@query(
    f"""with {EVENTS}, s as (select *, case when {sql_draw32(3, 'split', 'event_id')} / 4294967296.0 < 0.7 then 'tr' else 'te' end split from base)
select kind a, u b, round(avg(y) filter (split = 'tr'), 6) train_rate, count(*) filter (split = 'tr') train_n, round(avg(y) filter (split = 'te'), 6) test_rate, count(*) filter (split = 'te') test_n
from s group by 1, 2 having count(*) filter (split = 'tr') >= 20"""
)
def cell_table(spark, d):
    rows = split.hash_split(event_rows(spark, d), "event_id", 0.7, 3)
    return rounded(criterion.cell_table(rows, "kind", "u", min_cell=20), "train_rate", "test_rate")


@query(f"with {EVENTS}, c as (select kind, u, count(*) n from base group by 1, 2) select round(max(n) / sum(n), 6) max_share, round(count(*) / 100.0, 6) occupied from c")
def max_cell_share(spark, d):
    return rounded(criterion.cell_shares(event_rows(spark, d), "kind", "u", 10), "max_share", "occupied")


# ---- nulls, samples, ranks ------------------------------------------------------------------------------------------


PERMUTED = f"""{EVENTS}, nat as (select *, row_number() over (order by event_id) r from base), g as (select unnest(range(5)) draw),
h as (select draw, err moved, row_number() over (partition by draw order by md5('11.' || draw || ':perm:' || event_id), event_id) r from base, g),
p as (select draw, kind, u, v, moved err from nat join h using (r)), {pair_sql(['kind', 'u', 'v'], keys='draw', source='p')}"""


@query(f"with {PERMUTED} select cast(draw as int) draw, cast(i as int) i, cast(j as int) j, round(score, 6) score from scores")
def permutation_null(spark, d):
    return rounded(nulls.null_scores(event_rows(spark, d), "event_id", ["kind", "u", "v"], "err", 5, 11), "score")


@query(f"with {PERMUTED}, b as (select draw, max(score) best from scores group by 1) select round(quantile_cont(best, 0.95), 6) threshold from b")
def null_threshold(spark, d):
    return rounded(nulls.null_threshold(nulls.null_scores(event_rows(spark, d), "event_id", ["kind", "u", "v"], "err", 5, 11)), "threshold")


@query(f"with {PERMUTED}, b as (select draw, score from scores where i = 0 and j = 1) select round(avg(score), 6) null_mean, round(stddev_pop(score), 6) null_std from b")
def null_moments(spark, d):
    s = nulls.null_scores(event_rows(spark, d), "event_id", ["kind", "u", "v"], "err", 5, 11).where("i = 0 and j = 1")
    return s.agg(F.round(F.avg("score"), 6).alias("null_mean"), F.round(F.stddev_pop("score"), 6).alias("null_std"))


@query("select cast(a.i as int) i, cast(b.i as int) j from (select unnest(range(10)) i) a join (select unnest(range(10)) i) b on a.i < b.i order by md5('5:sample:' || a.i || ',' || b.i), 1, 2 limit 12")
def sample_pairs(spark, d):
    return candidates.sample(candidates.pairs_frame(spark, 10), 12, 5)


@query("select cast(a.i as int) i, cast(b.i as int) j from (select unnest(range(8)) i) a join (select unnest(range(8)) i) b on a.i < b.i where not (b.i = a.i + 1)")
def candidates_anti_join(spark, d):
    every = candidates.pairs_frame(spark, 8)
    return candidates.remaining(every, every.where("j = i + 1"))


@query("select cast(count(*) as bigint) hits from (select a.i, b.i j from (select unnest(range(8)) i) a join (select unnest(range(8)) i) b on a.i < b.i where (a.i + b.i) % 3 = 0 and b.i = a.i + 1)")
def candidate_hits(spark, d):
    every = candidates.pairs_frame(spark, 8)
    return candidates.hits(every.where("(i + j) % 3 = 0"), every.where("j = i + 1"))


@query(f"with {LINES}, {pair_sql(FIELDS)}, s1 as (select i, j, score from scores), u as (select i, j, sum(pow(s - n / nn * ss, 2)) score from centred group by 1, 2) select round(corr(s1.score, u.score), 6) correlation from s1 join u using (i, j)")
def score_corr(spark, d):
    cells = criterion.pair_cells(line_items(spark, d), FIELDS, ["err"])
    w = criterion.scores_of_cells(cells)
    u = criterion.scores_of_cells(cells, weighted=False).withColumnRenamed("score", "other")
    return w.join(u, ["i", "j"]).agg(F.round(F.corr("score", "other"), 6).alias("correlation"))


@query(f"with {LINES}, {pair_sql(FIELDS)} select round(avg(cast(score > (select min(score) from scores) + 1e-9 as int)), 6) frac_beaten from scores")
def frac_beaten(spark, d):
    s = criterion.pair_scores(line_items(spark, d), FIELDS)
    least = s.agg(F.min("score").alias("m")).first()["m"]
    return rounded(candidates.frac_beaten(s, least, "score"), "frac_beaten")


# ---- encodings, splits, gates, statistics ---------------------------------------------------------------------------


@query("select event_type, cast(dense_rank() over (order by event_type) - 1 as int) code from (select distinct event_type from events)")
def category_codes(spark, d):
    return encode.dictionary(table(spark, d, "events"), "event_type")


@query("select f field, cast(count(distinct val) as bigint) n_values, count(distinct val) < 3 degenerate from (select unnest(['l_returnflag', 'l_linestatus', 'l_linenumber']) f, unnest([l_returnflag, l_linestatus, cast(l_linenumber as varchar)]) val from lineitem) group by 1")
def field_degeneracy(spark, d):
    return encode.degenerate_fields(table(spark, d, "lineitem"), FIELDS[:3])


@query("select count(distinct l_returnflag) l_returnflag, count(distinct l_discount) l_discount, count(distinct l_tax) l_tax from lineitem")
def field_sizes(spark, d):
    return encode.field_sizes(table(spark, d, "lineitem"), ["l_returnflag", "l_discount", "l_tax"])


@query(f"with s as (select case when {sql_draw32(7, 'split', 'event_id')} / 4294967296.0 < 0.7 then 'tr' else 'te' end split from events) select split, count(*) n from s group by 1")
def hash_split(spark, d):
    return split.hash_split(table(spark, d, "events"), "event_id", 0.7, 7).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("with r as (select event_id, row_number() over (order by md5('7:split:' || event_id), event_id) r, count(*) over () n from events) select event_id, case when r <= floor(n * 0.7) then 'tr' else 'te' end split from r")
def hash_order_split(spark, d):
    return split.hash_order_split(table(spark, d, "events"), "event_id", 0.7, 7).select("event_id", "split")


@query("with n as (select count(*) n from events) select cast(b as int) block, count(*) n from (select (select max(k) from (select unnest(range(8)) k) where event_id >= k * n // 8) b from events, n) group by 1")
def block_split(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(split.block_of(F.col("event_id"), e.count()).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("with n as (select count(*) n, 7 * count(*) // 8 s from events), t as (select event_id t, s, n, s + (n - s) // 24 * 24 w from events, n) select count(*) positions, sum(t) total from t where t >= s + 3 and t < w and t + 2 < n and (t - s) % 24 >= 3")
def eval_positions(spark, d):
    e = table(spark, d, "events")
    n = e.count()
    return e.where(split.eval_positions(F.col("event_id"), 7 * n // 8, n, 2, 3)).agg(F.count(F.lit(1)).alias("positions"), F.sum("event_id").alias("total"))


@query("with c as (select event_type, count(*) n from events group by 1), p as (select n / sum(n) over () p from c) select round(sum(-p * log2(p)), 6) entropy from p")
def label_entropy(spark, d):
    return rounded(metrics.entropy(table(spark, d, "events"), "event_type"), "entropy")


@query("select round(quantile_cont(value, 0.95), 6) q from events")
def quantile_95(spark, d):
    return table(spark, d, "events").agg(F.round(F.percentile("value", 0.95), 6).alias("q"))


@query("with p as (select least(greatest(value / 200, 1e-9), 1 - 1e-9) p, cast(user_id % 2 as int) y, cast(value > 100 as int) pred from events) select round(avg(-log2(case when y = 1 then p else 1 - p end)), 6) bits, round(avg(cast(pred = y as int)), 6) acc from p")
def binary_bits(spark, d):
    e = table(spark, d, "events").select((F.col("value") / 200).alias("p"), (F.col("user_id") % 2).cast("int").alias("y"), (F.col("value") > 100).cast("int").alias("pred"))
    return e.agg(F.round(metrics.binary_bits(F.col("p"), F.col("y")), 6).alias("bits"), F.round(metrics.accuracy(F.col("pred"), F.col("y")), 6).alias("acc"))


@query(
    f"with {EVENTS}, k as (select cast(dense_rank() over (order by kind) - 1 as int) c0, u c1, v c2 from base) "
    + " union all ".join(f"select {i} i, {j} j, c{i} a, c{j} b, count(*) n from k group by all" for i in range(3) for j in range(i, 3))
)
def gram_counts(spark, d):
    rows = encode.encode(event_rows(spark, d), ["kind"]).select(F.col("kind_code").cast("int").alias("c0"), F.col("u").alias("c1"), F.col("v").alias("c2"))
    return suffstats.pairwise_counts(rows, ["c0", "c1", "c2"])


@query(f"with {STREAM} select a.t t, b.x lagged from stream a join stream b on b.t = a.t - 3 union all select t, null from stream where t < 3")
def lag_three(spark, d):
    return lags.with_lags(symbol_stream(spark, d), [3], chunk=1000).select("t", F.col("x3").alias("lagged"))


@query(f"with {STREAM} select a.x x, b.x lagged, count(*) n from stream a join stream b on b.t = a.t - 5 group by 1, 2")
def lag_join_counts(spark, d):
    return lags.lag_join(symbol_stream(spark, d), 5).groupBy("x", "lagged").agg(F.count(F.lit(1)).alias("n"))


# ---- tokens and vocabulary ------------------------------------------------------------------------------------------


@query(r"with w as (select unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) word from documents) select word, count(*) n from w group by 1 order by n desc, word limit 50")
def word_tokens_topk(spark, d):
    w = tokens.word_tokens(table(spark, d, "documents"), "doc_id", "text")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("with b as (select unnest(regexp_extract_all(hex(encode(text)), '..')) h from documents) select cast('0x' || h as int) raw, count(*) n from b group by 1")
def byte_histogram(spark, d):
    return tokens.byte_tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


VOCAB = f"""{STREAM}, n as (select count(*) n from stream), f as (select x, count(*) c from stream, n where t < 7 * n // 8 group by 1 order by c desc, x limit 3),
v as (select x, cast(row_number() over (order by c desc, x) as int) tok from f), m as (select t, coalesce(tok, 0) tok, t < 7 * n // 8 train from stream left join v using (x), n)"""


def coded_stream(spark, d):
    s = symbol_stream(spark, d)
    n = s.count()
    vocab = tokens.vocabulary(s, "x", 4, F.col("t") < 7 * n // 8)
    return tokens.apply_vocabulary(s, vocab, "x").withColumn("train", F.col("t") < 7 * n // 8)


@query(f"with {VOCAB} select train, round(avg(cast(tok = 0 as int)), 6) unk_rate, count(*) n from m group by 1")
def vocab_unk_rate(spark, d):
    return rounded(coded_stream(spark, d).groupBy("train").agg(metrics.share(F.col("tok") == 0).alias("unk_rate"), F.count(F.lit(1)).alias("n")), "unk_rate")


@query(
    f"""with {VOCAB}, e as (select tok, count(*) / sum(count(*)) over () pe from m where not train group by 1), p as (select tok, count(*) / sum(count(*)) over () pt from m where train group by 1)
select round(sum(pe * log2(pe / greatest(coalesce(pt, 0), 1e-12))), 6) kl from e left join p using (tok)"""
)
def block_split_kl(spark, d):
    m = coded_stream(spark, d)
    return rounded(metrics.divergence(m.where("not train"), m.where("train"), "tok"), "kl")


@query(f"with {VOCAB}, c as (select tok, count(*) n from m where train group by 1) select round(max(n) / sum(n), 6) top1_share from c")
def top1_share(spark, d):
    h = metrics.histogram(coded_stream(spark, d).where("train"), "tok")
    return h.agg(F.round(F.max("p"), 6).alias("top1_share"))


def document_words(spark, d):
    return tokens.dense_tokens(table(spark, d, "documents"), "doc_id", "text")


WORDS = r"""w0 as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]'), 1) p from documents),
w as (select row_number() over (order by doc_id, p) - 1 t, word from w0)"""


@query(f"with {WORDS} select word, min(t) \"first\", row_number() over (order by min(t)) - 1 raw from w group by 1")
def first_seen_ids(spark, d):
    w = document_words(spark, d)
    ids = tokens.first_seen_ids(w)
    firsts = w.groupBy("word").agg(F.min("t").alias("first"))
    return ids.join(firsts, "word").select("word", "first", F.col("raw").cast("long").alias("raw"))


@query(
    f"""with {WORDS}, b as (select t - t % 7 b, t % 7 p, word from w), full_ as (select b, b // 7 block from b group by 1 having count(*) = 7),
c as (select b, row_number() over (order by md5('1:record:' || block), block) - 1 rec from full_ order by md5('1:record:' || block), block limit 20000), n as (select count(*) n from c),
h as (select rec, p, word from b join c using (b) where p < 4 or p = 6), f as (select word, count(*) k from h, n where rec < cast(floor(n * 0.7) as bigint) group by 1 order by k desc, word limit 15),
v as (select word, cast(row_number() over (order by k desc, word) as int) tok from f), m as (select rec, p, coalesce(tok, 0) tok from h left join v using (word))
select rec, max(tok) filter (p = 0) f0, max(tok) filter (p = 1) f1, max(tok) filter (p = 2) f2, max(tok) filter (p = 3) f3, max(tok) filter (p = 6) f4, cast((max(tok) filter (p = 0) + max(tok) filter (p = 6)) % 2 as int) y from m group by 1"""
)
def word_block_fields(spark, d):
    return tokens.records(document_words(spark, d), 5, 20_000, 1, 16).select(F.col("rec").cast("long").alias("rec"), "f0", "f1", "f2", "f3", "f4", "y")


# ---- generators -----------------------------------------------------------------------------------------------------


def sym_sql(seed: int, lag: int, alphabet: int) -> str:
    return f"case when t >= {lag} then {sql_draw32(seed, 'x', f't - {lag}')} % {alphabet} end"


@query(f"select t, cast({sym_sql(1, 0, 8)} as int) x, cast(({sym_sql(1, 0, 8)} + {sym_sql(1, 4, 8)}) % 8 as int) y from (select unnest(range(2000)) t)")
def single_interaction(spark, d):
    return generators.single_interaction(spark, 2000, 8, 4, 1)


@query(f"select t, cast({sym_sql(2, 0, 5)} as int) x, cast(({sym_sql(2, 0, 5)} + {sym_sql(2, 1, 5)} + {sym_sql(2, 3, 5)}) % 5 as int) y from (select unnest(range(2000)) t)")
def multi_sum_stream(spark, d):
    return generators.multi_sum(spark, 2000, 5, [0, 1, 3], 2)


@query(f"with c as (select t, {sym_sql(3, 0, 8)} x, ({sym_sql(3, 1, 8)} + {sym_sql(3, 2, 8)}) % 2 y_0, ({sym_sql(3, 3, 8)} + {sym_sql(3, 5, 8)}) % 2 y_1 from (select unnest(range(2000)) t)) select t, cast(x as int) x, cast(y_0 + 2 * y_1 as int) y, cast(y_0 as int) y_0, cast(y_1 as int) y_1 from c")
def components_stream(spark, d):
    return generators.components_stream(spark, 2000, 8, [(1, 2), (3, 5)], 2, 3)


@query(f"select t, cast({sym_sql(4, 0, 6)} as int) x, cast({sym_sql(4, 0, 6)} as int) y from (select unnest(range(1000)) t)")
def additive_stream(spark, d):
    return generators.additive_stream(spark, 1000, 6, 4)


@query(
    f"""with {STREAM}, l as (select a.t t, b.x x1, c.x x8 from stream a join stream b on b.t = a.t - 1 join stream c on c.t = a.t - 8)
select t, cast(case when {sql_draw32(9, 'noise', 't')} / 4294967296.0 < 0.25 then {sql_draw32(9, 'label', 't')} % 2 else (x1 + x8) % 2 end as int) y from l"""
)
def injected_noise(spark, d):
    rows = lags.with_lags(symbol_stream(spark, d), [1, 8]).where("x8 is not null")
    return generators.injected(rows, "x1", "x8", 2, 0.25, 9).select("t", "y")


@query(
    f"""with {STREAM}, l as (select a.t t, b.x x1, c.x x8 from stream a join stream b on b.t = a.t - 1 join stream c on c.t = a.t - 8), n as (select x1, count(*) n from l group by 1),
r as (select k from (select unnest(range(5)) k) left join n on x1 = k order by coalesce(n, 0), k limit 2)
select t, x1 in (select k from r) informative, cast(case when x1 in (select k from r) then (x1 + x8) % 2 else {sql_draw32(9, 'rare', 't')} % 2 end as int) y from l"""
)
def rare_signal_mask(spark, d):
    rows = lags.with_lags(symbol_stream(spark, d), [1, 8]).where("x8 is not null")
    return generators.rare_signal(generators.injected(rows, "x1", "x8", 2), "x1", 2, 2, 9, 5).select("t", "informative", "y")


@query(f"with {STREAM} select row_number() over (order by md5('13:shuffle:' || t), t) - 1 t, x from stream")
def shuffled_stream(spark, d):
    return generators.shuffled(symbol_stream(spark, d), 13)


# ---- n-grams --------------------------------------------------------------------------------------------------------


def ngram_sql(source: str, train: str, test: str, order: int, alpha: str, v: int = 5, lag: int = 1) -> str:
    """CTEs pos (t, x0.., y) and probabilities p1..p{order} per test row."""
    joins = " ".join(f"join {source} l{i} on l{i}.t = a.t - {i}" for i in range(1, order - 1))
    cols = ", ".join(["a.x x0", *(f"l{i}.x x{i}" for i in range(1, order - 1))])
    out = f"pos as (select a.t t, {cols}, f.x y from {source} a {joins} join {source} f on f.t = a.t + {lag}), tr as (select * from pos where {train}), te as (select * from pos where {test})"
    p, joined = f"1.0 / {v}", ""
    names = []
    for n in range(1, order + 1):
        ctx = [f"x{i}" for i in range(n - 1)]
        cs = "".join(f"{c}, " for c in ctx)
        out += f", k{n} as (select {cs}y, count(*) c{n} from tr group by all), s{n} as (select {cs}sum(c{n}) n{n} from k{n} {'group by ' + ', '.join(ctx) if ctx else ''})"
        joined += f" left join k{n} using ({cs}y) " + (f"left join s{n} using ({', '.join(ctx)})" if ctx else f"cross join s{n}")
        p = f"((coalesce(c{n}, 0) + {alpha} * {p}) / (coalesce(n{n}, 0) + {alpha}))"
        names.append(f"{p} p{n}")
    return out + f", scored as (select te.*, {', '.join(names)} from te{joined})"


N = "(select count(*) from events)"
ORDERS = 3


def fit_sql(end: str) -> str:
    return f"t >= 0 and t + 1 < {end} and t - {ORDERS} + 1 >= 0"


TEST = f"t >= 7 * {N} // 8 + 2 and t < 7 * {N} // 8 + ({N} - 7 * {N} // 8) // 24 * 24 and t + 1 < {N} and (t - 7 * {N} // 8) % 24 >= 2"


def unpivot(expr: str, source: str) -> str:
    return " union all ".join(f"select {n} \"order\", {expr.format(n=n)} from {source}" for n in range(1, ORDERS + 1))


@query(f"with {STREAM}, {ngram_sql('stream', fit_sql(f'7 * {N} // 8'), TEST, ORDERS, '1.0')} {unpivot('round(avg(-log2(greatest(p{n}, 1e-12))), 6) bps, count(*) n', 'scored')}")
def ngram_bps(spark, d):
    s = symbol_stream(spark, d)
    n = s.count()
    te = 7 * n // 8
    card = ngram.evaluate(s, 5, ORDERS, 1, (0, te), split.eval_positions(F.col("t"), te, n, 1, 2), dict.fromkeys(range(1, ORDERS + 1), 1.0), with_accuracy=False)
    return rounded(card.select("order", "bps", "n"), "bps")


VSTART = f"(7 * {N} // 8 - greatest(256, (7 * {N} // 8) // 8))"


@query(
    f"with {STREAM}, g as (select unnest([0.01, 0.05, 0.2, 1.0, 10.0]::double[]) alpha), "
    + ngram_sql("stream", fit_sql(VSTART), f"t >= {VSTART} + 2 and t + 1 < 7 * {N} // 8", ORDERS, "alpha").replace("te as (select * from pos", "te as (select pos.*, alpha from pos, g")
    + " "
    + " union all ".join(f"select {n} \"order\", alpha, round(avg(-log2(greatest(p{n}, 1e-12))), 6) bps from scored group by alpha" for n in range(1, ORDERS + 1))
)
def ngram_alpha_bits(spark, d):
    s = symbol_stream(spark, d)
    return rounded(ngram.alpha_bits(s, 5, ORDERS, 1, 7 * s.count() // 8).select("order", "alpha", "bps"), "bps")


@query(
    f"with {STREAM}, g as (select unnest([0.01, 0.05, 0.2, 1.0, 10.0]::double[]) alpha), "
    + ngram_sql("stream", fit_sql(VSTART), f"t >= {VSTART} + 2 and t + 1 < 7 * {N} // 8", ORDERS, "alpha").replace("te as (select * from pos", "te as (select pos.*, alpha from pos, g")
    + ", b as ("
    + " union all ".join(f"select {n} o, alpha, avg(-log2(greatest(p{n}, 1e-12))) bps from scored group by alpha" for n in range(1, ORDERS + 1))
    + ") select cast(o as int) \"order\", arg_min(alpha, bps) alpha from b group by 1"
)
def ngram_alpha_select(spark, d):
    s = symbol_stream(spark, d)
    return ngram.alpha_choice(ngram.alpha_bits(s, 5, ORDERS, 1, 7 * s.count() // 8))


@query(
    f"with {STREAM}, {ngram_sql('stream', fit_sql(f'7 * {N} // 8'), TEST, 2, '1.0').replace(f't - {ORDERS} + 1', 't - 2 + 1')}, q as (select distinct x0 from te), yy as (select unnest(range(5)) y), "
    "d as (select x0, y, (coalesce(c2, 0) + 1.0 * ((coalesce(c1, 0) + 1.0 / 5) / (n1 + 1.0))) / (coalesce(n2, 0) + 1.0) p from q cross join yy left join k1 using (y) cross join s1 left join k2 using (x0, y) left join s2 using (x0)), "
    "b as (select x0, y pred from d qualify row_number() over (partition by x0 order by p desc, y) = 1), z as (select *, -log2(greatest(p2, 1e-12)) hit from scored join b using (x0)) "
    "select 2 \"order\", round(avg(hit), 6) bps, round(avg(cast(pred = y as int)), 6) acc, count(*) n, round(avg(cast(y = 0 as int)), 6) unk_true_rate, round(avg(cast(pred = 0 as int)), 6) unk_pred_rate, "
    "round(avg(hit) filter (y <> 0), 6) bps_real, round(avg(cast(pred = y as int)) filter (y <> 0), 6) acc_real, count(*) filter (y <> 0) n_real from z"
)
def ngram_scorecard(spark, d):
    s = symbol_stream(spark, d)
    n = s.count()
    te = 7 * n // 8
    card = ngram.evaluate(s, 5, 2, 1, (0, te), split.eval_positions(F.col("t"), te, n, 1, 2), {1: 1.0, 2: 1.0}).where(F.col("order") == 2)
    return rounded(card, "bps", "acc", "unk_true_rate", "unk_pred_rate", "bps_real", "acc_real")


SHUFFLED = f"{STREAM}, sh as (select row_number() over (order by md5('13:shuffle:' || t), t) - 1 t, x from stream)"


@query(
    f"with {SHUFFLED}, {ngram_sql('sh', fit_sql(f'7 * {N} // 8'), TEST, ORDERS, '10.0')}, m as (select avg(-log2(greatest(p1, 1e-12))) b1, avg(-log2(greatest(p2, 1e-12))) b2, avg(-log2(greatest(p3, 1e-12))) b3 from scored) "
    "select round(least(b2, b3) - b1, 6) margin, least(b2, b3) - b1 > -0.02 passes from m"
)
def shuffled_control(spark, d):
    s = generators.shuffled(symbol_stream(spark, d), 13)
    n = s.count()
    te = 7 * n // 8
    card = ngram.evaluate(s, 5, ORDERS, 1, (0, te), split.eval_positions(F.col("t"), te, n, 1, 2), dict.fromkeys(range(1, ORDERS + 1), 10.0), with_accuracy=False)
    unigram = card.where(F.col("order") == 1).select(F.col("bps").alias("unigram_bps"))
    return rounded(verdict.leak_control(card.where(F.col("order") > 1).join(F.broadcast(unigram))), "margin")


# ---- verdicts and summaries -----------------------------------------------------------------------------------------


@query("select * from (values (1, 'no_pair_helps'), (2, 'inside_null'), (3, 'clears_null'), (4, 'no_pair_helps')) t(case_id, verdict)")
def verdicts(spark, d):
    rows = spark.createDataFrame([(1, 0.5, 0.5, 9.0, 1.0), (2, 0.4, 0.5, 1.0, 1.0), (3, 0.4, 0.5, 2.0, 1.0), (4, None, 0.5, 2.0, 1.0)], "case_id int, best double, additive double, score double, thr double")
    return rows.select("case_id", verdict.interaction_verdict(F.col("best"), F.col("additive"), F.col("score"), F.col("thr")).alias("verdict"))


# ---- modes: fitted models, rows only --------------------------------------------------------------------------------


@query()
def detect_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select(*[F.col(f).cast("string").alias(f) for f in FIELDS], (F.col("l_quantity") > 25).cast("int").alias("target"))
    return detect(rows, "target", draws=5).pairs


@query()
def detect_documents(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", "quality")
    return detect(rows, "quality", "lang,source", id_col="doc_id", draws=5).summary


SMALL = {"K": 5, "samples": 3000}

for _name, _mode in {
    "mode_demo": lambda s: modes.demo(s, **SMALL, n_cand=8, W=6, k=4, draws=5), "mode_envelope": lambda s: modes.envelope(s, (5,), (8,), (3000,), (0, 1), W=6),
    "mode_vs_gbdt": lambda s: modes.vs_gbdt(s, K=3, samples=2000, W=5, rounds=2), "mode_vs_all": lambda s: modes.vs_all(s, K=3, samples=2000, W=5, rounds=2),
    "mode_boosting": lambda s: modes.boosting(s, M=2, K=4, samples=3000, W=5, opponent_rounds=10, epochs=100), "mode_boosting2": lambda s: modes.boosting2(s, (1,), K=4, samples=3000, W=5, opponent_rounds=10, epochs=100),
    "mode_multi": lambda s: modes.multi(s, M=2, K=4, samples=3000, W=5), "mode_speed": lambda s: modes.speed(s, K=6, samples=3000, opponent_rounds=10),
    "mode_als": lambda s: modes.als(s, K=5, samples=3000), "mode_alsmulti": lambda s: modes.alsmulti(s, M=2, K=4, samples=3000, W=5),
    "mode_pool": lambda s: modes.pool_mode(s, N=15, K=4, samples=3000, draws=5), "mode_emit": lambda s: modes.emit(s, K=6, samples=3000),
}.items():
    QUERIES[_name] = lambda s, d, f=_mode: f(s)


@query()
def mode_real(spark, d):
    s = coded_stream(spark, d).select("t", F.col("tok").alias("x"))
    return modes.real(spark, s, s.count(), 4, stride=4).unionByName(modes.real(spark, s, s.count(), 4, stride=4, rare=1))


@query()
def mode_natural(spark, d):
    s = coded_stream(spark, d).select("t", F.col("tok").alias("x"))
    return modes.natural(spark, s, s.count(), 4, window=5, stride=3, n_rand=3)


@query()
def mode_fields(spark, d):
    return modes.fields_mode(spark, document_words(spark, d), 5, 8, rounds=2)


@query()
def mode_tune(spark, d):
    return modes.tune(spark, document_words(spark, d), 5, 8, 20_000, grid=[{"kind": "gbt", "depth": 2, "rounds": r, "rate": 0.3} for r in (1, 2)])


@query()
def mode_gbm(spark, d):
    return modes.gbm(spark, document_words(spark, d), fields=5, K=8, limit=20_000, grid=[{"kind": "gbt", "depth": 3, "rounds": 2, "rate": 0.1}])


@query()
def mode_real_bytes(spark, d):
    p = ngram_program.prepare(ngram_program.symbols(table(spark, d, "documents"), "doc_id", "text", "byte"), "byte", 32)
    return modes.real(spark, p.packed, p.n, 32, rare=4)


@query()
def ngram_family(spark, d):
    return ngram_program.run(spark, table(spark, d, "documents"), "doc_id", "text", grans=("word",), ks=(16,), lags=(1,), orders=3)


@query(
    """with b as (select unnest(regexp_extract_all(hex(encode(text)), '..')) h, doc_id, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) p from documents),
r as (select row_number() over (order by doc_id, p) - 1 t, cast('0x' || h as int) raw from b), n as (select 7 * count(*) // 8 e from r),
f as (select raw, count(*) c from r, n where t < e group by 1 order by c desc, raw limit 15), c as (select t < e train, coalesce(f.raw, -1) tok from r left join f using (raw), n)
select train, tok = -1 unk, count(*) n from c group by 1, 2"""
)
def byte_vocabulary_unknowns(spark, d):
    p = ngram_program.prepare(ngram_program.symbols(table(spark, d, "documents"), "doc_id", "text", "byte"), "byte", 16)
    return p.stream.groupBy((F.col("t") < p.train_end).alias("train"), (F.col("x") == 0).alias("unk")).agg(F.count(F.lit(1)).alias("n"))


from . import operator_queries  # noqa: E402, F401 (registers its queries)
