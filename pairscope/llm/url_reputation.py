"""URL verdicts from explicit rules and an empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted per host, which is the only pass over the pages before they are
judged; registered domains and suffixes are sums over hosts.  Each level is a
beta-binomial whose prior mean is the shrunk mean of the level above and whose concentration is estimated by moments;
a host is blocked when the upper posterior bound of its good rate lies under the threshold.

Defined cases: a null url or one without "://" has an empty host and path and shares the reputation of the empty host;
pages that repeat are judged each and count each; a null page id has no outcome; several outcomes for one page all count; without any outcome every host has the
global prior; an empty table gives an empty table.  Columns that clash with the output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, scratch, stored

#: Default of the parameter `suffixes`: suffixes of two labels under which names are registered; all others count one
#: label.  A caller with a public suffix list passes its two-label entries.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn", "co.za")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) between the first :// and /, ?, # or the end; path from there to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (action, "host/path") that fits; nulls where none does.  Rules are a short
    configuration list and become one CASE expression."""
    rule, verdict = None, None
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(last)


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def concentration(units: DataFrame, mean: str) -> float:
    """Beta-binomial concentration of units (n, s) around their prior mean column, by moments, within [1, 1e4]."""
    p = F.col(mean)
    u = units.where(F.col("n") > 0)
    r = u.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - p, 2) / (p * (1 - p))).alias("x"),
    ).first()
    if not r["k"] or r["n"] <= r["k"]:
        return 10.0
    rho = (r["x"] - r["k"]) / (r["n"] - r["k"])
    return 1e4 if rho <= 1e-4 else min(1e4, max(1.0, 1 / rho - 1))


def host_reputation(hosts: DataFrame, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Stored hosts (host, n, s) with posterior columns mean and sd; one row per host, sums per level are pre-aggregated and
    stored, so that each is counted once however often it is used.

    A prior never holds the outcomes it is applied to: a host is shrunk to its domain without the host, a domain to its
    suffix without the domain."""
    named = hosts.select("host", "n", "s", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"))
    total = named.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = ((total["s"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s")]

    def without(outer: DataFrame, inner: DataFrame, key: str, prior, k: float, out: str) -> DataFrame:
        """inner with the shrunk rate of its outer unit, less its own outcomes."""
        both = inner.join(outer.withColumnsRenamed({"n": "n_out", "s": "s_out"}), key)
        return both.withColumn(out, (F.col("s_out") - F.col("s") + k * prior) / (F.col("n_out") - F.col("n") + k)).drop("n_out", "s_out")

    domains = stored(named.groupBy("suffix", "domain").agg(*sums), "domains")
    tops = stored(domains.groupBy("suffix").agg(*sums), "suffixes")
    k_suffix = concentration(tops.withColumn("m", F.lit(overall)), "m")
    by_suffix = stored(without(tops, domains, "suffix", F.lit(overall), k_suffix, "m_suffix"), "by-suffix")
    k_domain = concentration(by_suffix, "m_suffix")
    level = stored(without(by_suffix.drop("suffix"), named, "domain", F.col("m_suffix"), k_domain, "m_domain"), "by-domain")
    k = concentration(level, "m_domain")
    a = F.col("s") + k * F.col("m_domain")
    ab = F.col("n") + F.lit(k)
    return level.select(
        "host", "domain", "suffix", "n", "s", (a / ab).alias("mean"), F.sqrt(a * (ab - a) / (ab * ab * (ab + 1))).alias("sd")
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
    z: float = 1.645,
    suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """pages with host, path, rule, verdict, posterior_mean and posterior_upper; outcomes is (id_col, good)."""
    own = ("host", "path", "rule", "verdict", "posterior_mean", "posterior_upper")
    host, path = host_and_path(F.col(url_col))
    named = pages.select(*[c for c in pages.columns if c.lower() not in own], host.alias("host"), path.alias("path"))
    counted = outcomes.where(F.col("good").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("good").alias("n"), F.sum(F.col("good").cast("double")).alias("s"))
    with scratch() as keep:
        hosts = (
            pages.select(F.col(id_col).alias("id"), host.alias("host"))
            .join(counted, "id", "left")
            .groupBy("host")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
        )
        known = host_reputation(stored(hosts, "hosts"), suffixes)
        known = stored(known.select("host", F.col("mean").alias("posterior_mean"), (F.col("mean") + z * F.col("sd")).alias("posterior_upper")), "known-hosts")
        keep(known)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("posterior_upper") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return named.join(known, "host", "left").select(
        *[c for c in pages.columns if c.lower() not in own], "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "posterior_mean", "posterior_upper"
    )
