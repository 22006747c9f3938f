"""Registered queries of single operators that the larger queries use, each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.hashing import sql_draw32
from ..operators import candidates, criterion, encode, lags, nulls, readout, split, suffstats, verdict
from ..sources import generators
from ..sources.shared import shared_root
from ..sources.tables import categorical_fields, csv_table, table
from . import cells, modes, ngram_program, run_mode
from .registry import EVENTS, FIELDS, LINES, ORACLES, ORDERS, SHUFFLED, STREAM, TEST, event_rows, fit_sql, line_items, ngram_sql, pair_sql, query, rounded, sym_sql, symbol_stream

# ---- sources --------------------------------------------------------------------------------------------------------


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_scan(spark, d):
    """A table written as CSV with a header and read back with an inferred schema."""
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    return csv_table(spark, path)


@query("select column_name field from (describe orders) where column_type = 'VARCHAR' and column_name <> 'o_orderstatus'")
def field_selection(spark, d):
    names = categorical_fields(table(spark, d, "orders"), "o_orderstatus")
    return spark.createDataFrame([(n,) for n in names], "field string")


@query(f"with {STREAM} select a.x x1, b.x y, count(*) n from stream a join stream b on b.t = a.t + 1 where (b.t - 3) % 5 = 0 and b.t >= 3 group by 1, 2")
def natural_target(spark, d):
    """The next symbol as target, at strided positions."""
    rows = lags.with_lags(symbol_stream(spark, d), [0, 1]).withColumn("y", F.col("x0"))
    return rows.where(split.strided(F.col("t"), 3, 5)).groupBy("x1", "y").agg(F.count(F.lit(1)).alias("n"))


# ---- projections and filters ----------------------------------------------------------------------------------------


@query("with n as (select count(*) n from events), s as (select event_id t, (event_id - 11) // 7 o, n from events, n where event_id >= 11 and (event_id - 11) % 7 = 0) select t, o ordinal, t < n // 2 first_half, o < cast(floor((n - 11 + 6) // 7 * 0.7) as bigint) train from s")
def position_splits(spark, d):
    """Strided positions with the half split and the 70/30 split by ordinal."""
    e = table(spark, d, "events").select(F.col("event_id").alias("t"))
    n = e.count()
    ordinal = F.floor((F.col("t") - 11) / 7)
    return e.where(split.strided(F.col("t"), 11, 7)).select("t", ordinal.alias("ordinal"), split.first_half(F.col("t"), n).alias("first_half"), split.ordinal_cut(ordinal, -(-(n - 11) // 7)).alias("train"))


@query("select distinct cast(floor(i * ((select count(*) from events) - 1) / 299.0) as bigint) ordinal from (select unnest(range(300)) i)")
def evenly_spaced_rows(spark, d):
    return spark.createDataFrame([(i,) for i in dict.fromkeys(split.evenly_spaced(table(spark, d, "events").count(), 300))], "ordinal long")


@query(f"with {EVENTS} select cast(u * 7 + v as int) cell, u a, v b, count(*) n from base group by 1, 2, 3")
def cell_ids(spark, d):
    """Cell ids of a pair and back again."""
    counts = event_rows(spark, d).groupBy(encode.cell_id(F.col("u"), F.col("v"), 7).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    a, b = encode.cell_parts(F.col("cell"), 7)
    return counts.select("cell", a.alias("a"), b.alias("b"), "n")


FIRST = 6
DESIGN = f"""s as (select t, {', '.join(f"{sym_sql(3, j, 8)} x{j}" for j in range(6))}, ({sym_sql(3, 1, 8)} + {sym_sql(3, 2, 8)}) % 2 y_0, ({sym_sql(3, 3, 8)} + {sym_sql(3, 5, 8)}) % 2 y_1 from (select unnest(range(4000)) t)),
design as (select *, y_0 + 2 * y_1 y, t < 2000 train, (t - {FIRST}) // 7 o from s where t >= {FIRST} and (t - {FIRST}) % 7 = 0 and y_1 is not null)"""


def small_design(spark):
    return cells.stream_design(generators.components_stream(spark, 4000, 8, [(1, 2), (3, 5)], 2, 3), 4000, 8, 4, 6, FIRST, heads=["y_0", "y_1"])


@query(f"with {DESIGN} select t, {', '.join(f'cast(x{j} as int) x{j}' for j in range(6))}, cast(y as int) y, cast(y_0 as int) y_0, cast(y_1 as int) y_1, train, o ordinal from design")
def stream_design(spark, d):
    """The rows behind an experiment cell: lags, defined target, stride, halves, ordinals."""
    made = small_design(spark)
    both = made.train.withColumn("train", F.lit(True)).unionByName(made.test.withColumn("train", F.lit(False)))
    return both.withColumn("ordinal", made.ordinal)


@query(f"with {DESIGN} select cast(x1 * 8 + x2 as int) cell, cast(y_0 as int) y, count(*) n from design where train group by 1, 2")
def pair_block_counts(spark, d):
    """A pair's joint block: its cells by the target."""
    made = small_design(spark)
    return cells.with_cell(made.train, "x1", "x2", made.alphabet).groupBy("cell", F.col("y_0").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("with r as (select l_quantity a, l_extendedprice / 10000 b, l_tax * 10 c, l_orderkey k, l_linenumber l from lineitem), e as (select *, greatest(a, b, c) m from r), s as (select *, exp((a - m) / 2) + exp((b - m) / 2) + exp((c - m) / 2) z from e) select k, l, round(exp((a - m) / 2) / z, 6) p0, round(exp((b - m) / 2) / z, 6) p1, round(exp((c - m) / 2) / z, 6) p2 from s")
def softmax_rows(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), metrics.softmax(F.array(F.col("l_quantity").cast("double"), (F.col("l_extendedprice") / 10000).cast("double"), (F.col("l_tax") * 10).cast("double")), 2.0).alias("p"))
    return rows.select("k", "l", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


# ---- fits with a closed form ----------------------------------------------------------------------------------------


def event_design(spark, d):
    rows = symbol_stream(spark, d).join(event_rows(spark, d).select(F.col("event_id").alias("t"), "y"), "t")
    return rows, rows.count(), table(spark, d, "events").select("event_type").distinct().count()


XY = f"{STREAM}, xy as (select t, x, cast(value > 50 as int) y from stream join events on event_id = t), n as (select count(*) // 2 h from xy)"


@query(f"with {XY}, c as (select unnest([0, 1]) c) select x, c \"class\", round(sum(cast(y = c as int) - 0.5), 6) \"value\" from xy, c group by 1, 2 union all select -1, c, round(sum(cast(y = c as int) - 0.5), 6) from xy, c group by 2")
def target_products(spark, d):
    """X'T of one-hot columns and the intercept (x = -1) with the centred one-hot target."""
    rows, _, k = event_design(spark, d)
    made = suffstats.target_products(suffstats.Tables(rows, ["x", "y"], [k, 2]), ["x"], "y")
    return spark.createDataFrame([(i if i < k else -1, c, round(float(made[i, c]), 6)) for i in range(k + 1) for c in range(2)], "x int, class int, value double")


# ridge weights of a single field: w_x = (s_x - b n_x) / (n_x + lam), b from the intercept's equation
RIDGE = f"""{XY}, fit as (select x, c, count(*) n, sum(cast(y = c as int) - 0.5) s from xy, n, (select unnest([0, 1]) c) where t < cast(floor(h * 0.7) as bigint) group by 1, 2),
b as (select c, (sum(s) - sum(n * s / (n + 0.01))) / (sum(n) + 0.01 + 1e6 - sum(n * n / (n + 0.01))) b from fit group by 1),
w as (select x, c, (s - b * n) / (n + 0.01) + b logit from fit join b using (c)),
wide as (select x, max(logit) filter (c = 0) l0, max(logit) filter (c = 1) l1 from w group by 1),
held as (select distinct cast(floor(h * 0.7) as bigint) + cast(floor(i * (h - cast(floor(h * 0.7) as bigint) - 1) / 2999.0) as bigint) t from n, (select unnest(range(3000)) i)),
grid as (select i, 0.001 * pow(10000.0, i / 119.0) temp from (select unnest(range(120)) i)),
loss as (select i, temp, avg(-log2(greatest(1 / (1 + exp((case when y = 1 then l0 - l1 else l1 - l0 end) / temp)), 1e-12))) z from held join xy using (t) join wide using (x), grid group by 1, 2),
best as (select temp from loss order by z, i limit 1)"""


def single_readout(spark, d):
    rows, n, k = event_design(spark, d)
    half = n // 2
    return rows, readout.fit_readout(rows.where(split.first_half(F.col("t"), n)), ["x"], [k], "y", 2, F.col("t"), half), half, k


@query(f"with {RIDGE} select x, c \"class\", round(logit, 6) logit from w")
def ridge_logits(spark, d):
    _, model, _, k = single_readout(spark, d)
    logits = model.logits([np.arange(k)])
    return spark.createDataFrame([(x, c, round(float(logits[x, c]), 6)) for x in range(k) for c in range(2)], "x int, class int, logit double")


@query(
    f"""with {RIDGE}, p as (select y, 1 / (1 + exp((l0 - l1) / temp)) p1 from xy join wide using (x), best, n where t >= h)
select round((select temp from best), 9) temperature, round(avg(-log2(greatest(case when y = 1 then p1 else 1 - p1 end, 1e-12))), 6) bits, round(avg(cast(cast(p1 > 0.5 as int) = y as int)), 6) acc from p"""
)
def readout_scores(spark, d):
    """Ridge read-out, temperature scan and held-out scores, whole."""
    rows, model, half, _ = single_readout(spark, d)
    return readout.score(rows.where(F.col("t") >= half), model).select(F.round(F.lit(model.temperature), 9).alias("temperature"), F.round("bits", 6).alias("bits"), F.round("acc", 6).alias("acc"))


@query(f"with {RIDGE} select x, y, count(*) n, round(avg(1 - 1 / (1 + exp((l0 - l1) / temp)) - cast(y = 0 as int)), 6) e0, round(avg(1 / (1 + exp((l0 - l1) / temp)) - y), 6) e1 from xy join wide using (x), best group by 1, 2")
def readout_residuals(spark, d):
    rows, model, _, _ = single_readout(spark, d)
    e = readout.residuals(rows, model)
    return e.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e0"), 6).alias("e0"), F.round(F.avg("e1"), 6).alias("e1"))


# ---- candidates, ranks, picks ---------------------------------------------------------------------------------------


@query(f"with {LINES}, {pair_sql(FIELDS)}, r as (select *, row_number() over (order by score desc, i, j) r from scores) select cast(i as int) i, cast(j as int) j from r where r = 2")
def runner_up(spark, d):
    i, j = cells.runner_up(criterion.pair_scores(line_items(spark, d), FIELDS))
    return spark.createDataFrame([(i, j)], "i int, j int")


@query(f"with {LINES}, {pair_sql(FIELDS)}, b as (select i, j, case when (i + j) % 3 = 0 then null when (i + j) % 3 = 1 then cast('nan' as double) else score end bits from scores) select cast(i as int) i, cast(j as int) j, row_number() over (order by case when isnan(bits) then null else bits end nulls last, i, j) \"rank\" from b")
def rank_by_bits(spark, d):
    """Ascending ranks; values that were not computed, null or NaN, come last."""
    s = criterion.pair_scores(line_items(spark, d), FIELDS)
    odd = F.col("i") + F.col("j")
    s = s.withColumn("bits", F.when(odd % 3 == 0, None).when(odd % 3 == 1, F.lit(float("nan"))).otherwise(F.col("score")))
    return candidates.ranked(s, "bits", ascending=True).select("i", "j", F.col("rank").cast("long").alias("rank"))


@query("with w as (select 45 size union all select 100), k as (select size, cast(ceil((1 + sqrt(1 + 8 * size)) / 2) as int) w from w), p as (select size, w, a.i, b.i j, row_number() over (partition by size order by a.i, b.i) r from k, (select unnest(range(20)) i) a, (select unnest(range(20)) i) b where a.i < b.i and b.i < w) select size, w \"window\", cast(i as int) i, cast(j as int) j from p where r <= size")
def pool_pairs(spark, d):
    return spark.createDataFrame([(size, candidates.pool(size)[0], i, j) for size in (45, 100) for i, j in candidates.pool(size)[1]], "size int, window int, i int, j int")


@query(
    f"""with {EVENTS}, s as (select *, case when {sql_draw32(3, 'split', 'event_id')} / 4294967296.0 < 0.7 then 'tr' else 'te' end split from base)
select kind a, u b, round(avg(y) filter (split = 'tr'), 6) train_rate, count(*) filter (split = 'tr') train_n, round(avg(y) filter (split = 'te'), 6) test_rate, count(*) filter (split = 'te') test_n
from s group by 1, 2 having count(*) filter (split = 'tr') >= 10 order by avg(y) filter (split = 'tr') desc, 4 desc, 1, 2 limit 8"""
)
def best_cells(spark, d):
    rows = split.hash_split(event_rows(spark, d), "event_id", 0.7, 3)
    return rounded(criterion.top_cells(criterion.cell_table(rows, "kind", "u", min_cell=10)), "train_rate", "test_rate")


@query("select K, samples, seed from (select unnest([8, 16, 32]) K), (select unnest([20000, 80000]) samples), (select 0 seed)")
def job_grid(spark, d):
    rows = run_mode.grid({"K": "8,16,32", "samples": "20000,80000", "seed": "0"})
    return spark.createDataFrame([(r["K"], r["samples"], r["seed"]) for r in rows], "K int, samples int, seed int")


@query("select * from (values ('0,4', true), ('1,1', false), ('0,1,3', true), ('2,5,2', false)) t(lags, accepted)")
def lag_validation(spark, d):
    """Streams refuse repeated lags."""

    def accepted(chosen: list[int]) -> bool:
        try:
            return generators.multi_sum(spark, 10, 3, chosen, 0) is not None
        except ValueError:
            return False

    return spark.createDataFrame([(",".join(map(str, x)), accepted(x)) for x in ([0, 4], [1, 1], [0, 1, 3], [2, 5, 2])], "lags string, accepted boolean")


# ---- nulls ----------------------------------------------------------------------------------------------------------


def moved_sql(k: int, seed: int, a: str, b: str, draws: int) -> str:
    """Scores of one pair with its second variable permuted, per draw."""
    return f"""select draw, {k} k, sum(pow(s - n / nn * ss, 2)) score from (select *, sum(n) over (partition by draw) nn, sum(s) over (partition by draw) ss from (select nat.draw draw, nat.{a} a, h.m b, count(*) n, sum(err) s
 from (select base.*, draw, row_number() over (partition by draw order by event_id) r from base, (select unnest(range({draws})) draw)) nat
 join (select draw, {b} m, row_number() over (partition by draw order by md5('{seed}.' || draw || ':perm:' || event_id), event_id) r from base, (select unnest(range({draws})) draw)) h on nat.draw = h.draw and nat.r = h.r group by all)) group by all"""


@query(f"with {EVENTS} select cast(draw as int) draw, round(score, 4) score from ({moved_sql(0, 17, 'kind', 'u', 4)})")
def pick_null(spark, d):
    """The null of the pick: its second variable permuted."""
    return rounded(nulls.second_variable_null(event_rows(spark, d), "event_id", "kind", "u", "err", 4, 17), "score", digits=4)


OWN = [(0, 1), (0, 2), (1, 2)]


@query(
    f"with {EVENTS}, o as ("
    + " union all ".join(moved_sql(k, 5 * 100_003 + k, ["kind", "u", "v"][i], ["kind", "u", "v"][j], 3) for k, (i, j) in enumerate(OWN))
    + "), b as (select draw, max(score) best from o group by 1) select round(quantile_cont(best, 0.95), 4) threshold from b"
)
def own_shuffle_threshold(spark, d):
    """The best of a pool when every candidate has its own shuffle in every draw."""
    made = nulls.own_shuffle_null(event_rows(spark, d), "event_id", ["kind", "u", "v"], OWN, ["err"], 3, 5)
    return rounded(nulls.null_threshold(made), "threshold", digits=4)


# ---- gates, verdicts, summaries -------------------------------------------------------------------------------------


@query("with g as (select f, count(*) n from (select unnest(['l_returnflag', 'l_linestatus', 'l_rare']) f, unnest([l_returnflag, l_linestatus, cast(l_quantity > 49 as varchar)]) v from lineitem) group by f, v), e as (select f field, sum(-n / t * log2(n / t)) e from (select *, sum(n) over (partition by f) t from g) group by 1) select field, round(e, 6) entropy, case when e < 0.2 then 'DEGENERATE: label entropy under 0.2 bits' end note from e")
def label_entropy_gate(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 49).cast("string").alias("l_rare"))
    out = None
    for f in rows.columns:
        one = metrics.entropy(rows, f).select(F.lit(f).alias("field"), F.round("entropy", 6).alias("entropy"), verdict.entropy_gate(F.col("entropy")).alias("note"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""with k as (select unnest([8, 32, 74, 75, 128]) K), w as (select K, 10 W, K * K + K * 10 + 1 width, K * K * K + K * 10 * K + K exact, 2 * K * 8 + 8 * K + K * 10 * K + K lowrank, K * 10 * K * 9 + K fm from k)
select K, case when width > 6000 then 'SKIPPED: width ' || width || ' > 6000' end width_note, cast(exact as bigint) exact, cast(lowrank as bigint) lowrank, cast(fm as bigint) fm, case when 20000 <= exact then 'SKIPPED: 20000 rows for ' || exact || ' parameters' end rows_note from w""")
def budgets(spark, d):
    """Width guard, parameters of every kind of read-out, identifiability."""
    rows = [(k, verdict.width_guard(k, 10), *(verdict.parameters(kind, k, k, 10) for kind in ("exact", "lowrank", "fm")), verdict.identifiable(20_000, verdict.parameters("exact", k, k, 10))) for k in (8, 32, 74, 75, 128)]
    return spark.createDataFrame(rows, "K int, width_note string, exact long, lowrank long, fm long, rows_note string")


@query("""with r as (select l_linenumber m, avg(l_tax) * 25 bar, avg(l_tax) * 25 + avg(l_discount) additive, avg(l_discount) * (l_linenumber - 1) / 2 oracle, min(l_tax) bits, avg(cast(l_quantity > 2 as int)) acc from lineitem group by 1)
select m, abs(additive - bar) <= 0.05 additive_ok, oracle <= 0.05 oracle_ok, abs(additive - bar) <= 0.05 and oracle <= 0.05 "valid", bits < 0.2 and acc > 0.95 opponent_ok from r""")
def instrument_gates(spark, d):
    """Gates of an instrument and of an opponent on arbitrary numbers, a row each."""
    m = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").groupBy(m.alias("m")).agg((F.avg("l_tax") * 25).alias("bar"), (F.avg("l_tax") * 25 + F.avg("l_discount")).alias("additive"), (F.avg("l_discount")).alias("oracle"), F.min("l_tax").alias("bits"), F.avg((F.col("l_quantity") > 2).cast("int")).alias("acc"))
    rows = rows.withColumn("oracle", F.col("oracle") * (F.col("m") - 1) / 2)
    return verdict.instrument_gates(rows, "bar", "additive", "oracle").select("m", "additive_ok", "oracle_ok", "valid", verdict.opponent_gate(F.col("bits"), F.col("acc")).alias("opponent_ok"))


@query("select l_returnflag arm, count(*) cells, count_if(l_linenumber = 1) \"first\", round(avg(l_linenumber), 6) mean_rank, round(avg(l_discount), 6) mean_bits from lineitem group by 1")
def sweep_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("bits"))
    return rounded(verdict.sweep_summary(rows, ["arm"]), "mean_rank", "mean_bits")


def cards_sql(source: str) -> str:
    b = ", ".join(f"avg(-log2(greatest(p{n}, 1e-12))) b{n}" for n in range(1, ORDERS + 1))
    return f"(with {SHUFFLED}, {ngram_sql(source, fit_sql('7 * (select count(*) from events) // 8'), TEST, ORDERS, '1.0')} select greatest({', '.join(f'b1 - b{n}' for n in range(2, ORDERS + 1))}) gain from (select {b} from scored))"


@query(f"with g as (select {cards_sql('stream')} gain union all select {cards_sql('sh')}) select round(min(gain), 6) worst_gain, min(gain) >= 0.2 authorised from g")
def authorisation(spark, d):
    """The bar over a sweep of two cells, the stream and its shuffle: the worst cell decides."""
    from ..operators import ngram

    out = None
    for gran, s in (("stream", symbol_stream(spark, d)), ("shuffled", generators.shuffled(symbol_stream(spark, d), 13))):
        n = s.count()
        te = 7 * n // 8
        card = ngram.evaluate(s, 5, ORDERS, 1, (0, te), split.eval_positions(F.col("t"), te, n, 1, 2), dict.fromkeys(range(1, ORDERS + 1), 1.0), with_accuracy=False)
        unigram = card.where(F.col("order") == 1).select(F.col("bps").alias("unigram_bps"))
        card = card.join(F.broadcast(unigram)).select(F.lit(gran).alias("gran"), F.lit(5).alias("k"), F.lit(1).alias("lag"), "order", "bps", "unigram_bps")
        out = card if out is None else out.unionByName(card)
    return rounded(ngram_program.bar(out), "worst_gain")


@query("with e as (select l_linenumber a, cast(l_discount * 100 as int) b, count(*) n, cast(avg(l_quantity) > 25.5 as int) g, (l_linenumber + cast(l_discount * 100 as int)) % 2 truth from lineitem group by 1, 2) select round(avg(cast(g = truth as int)), 6) exact, round(sum(n * cast(g = truth as int)) / sum(n), 6) weighted from e")
def emitted_accuracy(spark, d):
    """A table of a pair's cells against a rule: plain, and weighted by cell counts."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), (F.avg("l_quantity") > 25.5).cast("int").alias("g"))
    return rounded(modes.table_accuracy(rows.withColumn("truth", (F.col("a") + F.col("b")) % 2)), "exact", "weighted")


BYTES = """b as (select unnest(regexp_extract_all(hex(encode(text)), '..')) h, doc_id, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) p from documents),
r as (select row_number() over (order by doc_id, p) - 1 t, cast('0x' || h as int) raw from b), n as (select count(*) n, 7 * count(*) // 8 e from r),
f as (select raw, row_number() over (order by count(*) desc, raw) tok from r, n where t < e group by 1 order by 2 limit 63), c as (select t < e train, coalesce(tok, 0) x from r left join f using (raw), n)"""


@query(
    f"""with {BYTES}, h as (select train, x, count(*) k from c group by 1, 2), p as (select train, x, k / sum(k) over (partition by train) p from h),
kl as (select sum(a.p * log2(a.p / greatest(coalesce(b.p, 0), 1e-12))) kl from (select * from p where not train) a left join (select * from p where train) b using (x))
select 'byte' gran, 64 k, n, e train_end, round((select avg(cast(x = 0 as int)) from c where train), 9) train_unk_rate, round((select avg(cast(x = 0 as int)) from c where not train), 9) test_unk_rate,
 round((select max(p) from p where train), 9) top1_share, round((select kl from kl), 9) freq_kl from n"""
)
def corpus_statistics(spark, d):
    docs = table(spark, d, "documents")
    made = ngram_program.statistics(ngram_program.prepare(ngram_program.symbols(docs, "doc_id", "text", "byte"), "byte", 64))
    return rounded(made, "train_unk_rate", "test_unk_rate", "top1_share", "freq_kl", digits=9)


# mode emit at its registered size: the emitted class is the rule's in every cell
ORACLES["mode_emit"] = f"""with s as (select t, {sym_sql(0, 1, 6)} a, {sym_sql(0, 2, 6)} b from (select unnest(range(12000)) t)), c as (select a, b, count(*) n from s where t >= 4 and (t - 4) % 7 = 0 and t < 6000 group by 1, 2),
g as (select unnest(range(6)) k) select cast(x.k as int) a, cast(y.k as int) b, cast((x.k + y.k) % 2 as int) g, cast((x.k + y.k) % 2 as int) truth, coalesce(n, 0) n from g x cross join g y left join c on c.a = x.k and c.b = y.k"""
