"""DuckDB SQL of the training-data queries that SQL can express.

Toxicity (nearest examples with fitted calibration) and packing (tokenizer ids) have none; tests hold them against brute
force, exact round trips and held-out labels."""

from __future__ import annotations

from .queries import URL_RULES
from .url_reputation import TWO_LABEL_SUFFIXES

#: The six ASCII blanks as they stand in a pattern, and A-Z.
BLANK = r"[ \t\n\x0B\f\r]"
A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SAID = "</s>[INST] ok [/INST]"


def escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2 = f"""with t as (select conv_id, turn, coalesce(role, '') r, coalesce("text", '') x from conversations union all select -1, 0, 'user', '{SAID}' union all select -1, 1, 'assistant', '{SAID}')
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
 cast(coalesce(sum(length(x)) filter (r = 'assistant'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (r = 'assistant'), '')) loss_sha256,
 cast(sum(23 + length({escaped('r')}) + length({escaped('x')})) as bigint) formatted_chars from t group by 1"""


def rule_cases(what: int) -> str:
    out = ""
    for rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = rule[1].partition("/")
        out += f" when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + tail}') then '{rule[what]}'"
    return f"case{out} end"


TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def concentration(source: str, mean: str) -> str:
    """One-row query of the moment estimate, bounded as in the operator."""
    x = f"sum(n * pow(s / n - {mean}, 2) / ({mean} * (1 - {mean})))"
    rho = f"(({x}) - count(*)) / (sum(n) - count(*))"
    return f"select case when count(*) = 0 or sum(n) <= count(*) then 10.0 when {rho} <= 1e-4 then 1e4 else least(1e4, greatest(1.0, 1 / ({rho}) - 1)) end k from {source} where n > 0"


OP3 = f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {A_Z}) host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from u),
l as (select doc_id page_id, count(quality) n, cast(sum(quality) as double) s from labels where quality is not null group by 1),
h as (select host, cast(coalesce(sum(n), 0) as double) n, coalesce(sum(s), 0.0) s from p left join l using (page_id) group by 1),
parts as (select *, string_split(host, '.') d from h),
named as (select host, n, s, array_to_string(d[-2:], '.') in ({TWO}) two, d from parts),
hosts as (select host, n, s, array_to_string(case when two then d[-3:] else d[-2:] end, '.') dom, array_to_string(case when two then d[-2:] else d[-1:] end, '.') suf from named),
doms as (select suf, dom, sum(n) n, sum(s) s from hosts group by 1, 2), sufs as (select suf, sum(n) n, sum(s) s from doms group by 1),
g as (select (coalesce(sum(s), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) g from hosts), k0 as ({concentration('(select * from sufs, g)', 'g')}),
d1 as (select doms.*, (sufs.s - doms.s + k * g) / (sufs.n - doms.n + k) m from doms join sufs using (suf), g, k0), k1 as ({concentration('d1', 'm')}),
h1 as (select hosts.*, (d1.s - hosts.s + k * d1.m) / (d1.n - hosts.n + k) mh from hosts join d1 using (dom), k1), k2 as ({concentration('h1', 'mh')}),
post as (select host, s + k * mh a, n + k ab from h1, k2), up as (select host, a / ab + 1.645 * sqrt(a * (ab - a) / (ab * ab * (ab + 1))) up from post)
select page_id, host, path, {rule_cases(1)} "rule", coalesce({rule_cases(0)}, case when up < 0.5 then 'block' else 'allow' end) verdict from p left join up using (host)"""


def shingle_ctes(source: str, key: str, k: int, out: str) -> str:
    """Distinct k-word shingles per row of a table, the whole sequence where it is shorter."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(\"text\", ''), {A_Z}), '{BLANK}+'), lambda x: x <> '')"
    return f"""{out}_w as (select {key}, {words} w from {source}), {out} as (select distinct {key}, unnest(list_transform(range(1, greatest(len(w) - {k} + 1, 1) + 1), lambda i: array_to_string(w[i : i + {k} - 1], ' '))) s from {out}_w where len(w) > 0)"""


OP4 = f"""with {shingle_ctes('documents', 'doc_id', 5, 'd')}, {shingle_ctes('benchmark', 'item_id', 5, 'b')}, q as (select item_id, count(*) n from b group by 1),
m as (select doc_id, item_id, count(*) c from d join b using (s) group by 1, 2)
select doc_id, item_id, cast(c as int) shared, cast(n as int) item_shingles, c / n containment from m join q using (item_id) where 100 * c >= 80 * n"""

OP5 = """with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) v from embeddings where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: coalesce(not isfinite(x), true)))),
q as (select vec_id query_id, v w from v where vec_id % 50 = 0),
s as (select query_id, vec_id, cast(list_sum(list_transform(list_zip(w, v), lambda z: z[1] * z[2])) as bigint) score from q join v on query_id <> vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) select query_id, cast(r as int) "rank", vec_id, score from r where r <= 5"""

OP6 = f"""with l as (select doc_id, unnest(string_split(coalesce("text", ''), chr(10))) line, generate_subscripts(string_split(coalesce("text", ''), chr(10)), 1) pos from documents),
k as (select *, translate(regexp_replace(regexp_replace(line, '^{BLANK}+', ''), '{BLANK}+$', ''), {A_Z}) key from l),
c as (select key, max(doc_id) home from k where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5),
j as (select k.*, home is not null and doc_id <> home gone from k left join c using (key))
select doc_id, count(*) n_lines, count_if(gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from j group by 1"""

OP7 = f"""with recursive {shingle_ctes('documents', 'doc_id', 3, 'd')}, n as (select doc_id, count(*) n from d group by 1),
classes as (select doc_id, n, min(doc_id) over (partition by n, h) rep from (select doc_id, count(*) n, md5(string_agg(s, chr(10) order by s)) h from d group by 1)),
r as (select d.* from d join classes c on c.doc_id = d.doc_id and c.rep = c.doc_id),
rare as (select s from r group by 1 having count(*) > 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from (select * from r join rare using (s)) a join (select * from r join rare using (s)) b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ as (select a, b from e union select b, a from e), reach as (select a, a b from both_ union select reach.a, both_.b from reach join both_ on both_.a = reach.b),
comp as (select a rep, min(b) component_id from reach group by 1)
select documents.doc_id, coalesce(n.n, 0) n_shingles, coalesce(component_id, classes.rep, documents.doc_id) component_id, documents.doc_id = coalesce(component_id, classes.rep, documents.doc_id) kept
from documents left join n using (doc_id) left join classes using (doc_id) left join comp on comp.rep = classes.rep"""

#: kind, rank, pattern, smallest length, group that length is of.
SPAN_RULES = (
    ("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", 1, r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", 2, r"[0-9a-f]{24,}", 24, 0),
    ("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    ("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
)


def span_cte(kind: str, rank: int, pattern: str, least: int, group: int) -> str:
    """Offsets from the text left of the i-th match: its pieces and matches in front have known lengths."""
    m = f"regexp_extract_all(x, '{pattern}')"
    return f"""select doc_id, {rank} k, '{kind}' kind, m, g, pos, length(array_to_string(list_concat(pieces[:pos], before[:pos - 1]), '')) st from
 (select doc_id, unnest({m}) m, unnest(regexp_extract_all(x, '{pattern}', {group})) g, generate_subscripts({m}, 1) pos, regexp_split_to_array(x, '{pattern}') pieces, {m} before from t where regexp_matches(x, '{pattern}')) where length(g) >= {least}"""


OP8 = f"""with t as (select doc_id, coalesce("text", '') x from documents), s as ({' union all '.join(span_cte(*r) for r in SPAN_RULES)}),
z as (select doc_id, k, st, kind || ':' || st || ':' || (st + length(m)) span from s)
select t.doc_id, count(*) filter (k = 0) n_assign, count(*) filter (k = 1) n_access, count(*) filter (k = 2) n_hex, sha256(coalesce(string_agg(span, ',' order by st, k) filter (k < 3), '')) base_sha256,
 coalesce(string_agg(span, ',' order by st, k), '') spans from t left join z using (doc_id) group by 1"""

OP9 = """with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages), f as (select *, min(page_id) over (partition by x, strlen(h)) first_id from p)
select page_id, cast(strlen(h) as bigint) payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), '') payload_digest,
 case when first_id = page_id then 'response' else 'revisit' end record_type, case when first_id <> page_id then first_id end refers_to from f"""

ORACLES: dict[str, str] = {
    "op2_chat_format": OP2, "op3_url_reputation": OP3, "op4_decontamination": OP4, "op5_topk": OP5, "op6_line_dedup": OP6, "op7_near_dup": OP7, "op8_secret_scan": OP8, "op9_warc": OP9,
}
