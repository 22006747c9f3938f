"""Secret scans over an incremental blob ledger, DataFrame functions only.

Every version of every path is content-addressed by SHA-256.  Only (blob, rule set version) pairs missing from the
ledger are scanned, each blob once however many paths hold it; their entries are appended to the ledger, from which
findings are joined back to all paths.  A rule set's version is the digest of its rules, so changed rules scan anew by
themselves.

Spans are found without UDFs: the pieces between matches and the matches themselves give running code point offsets.

Defined cases: a null content is the empty blob; an empty blob has no findings; repeated rows each get the findings; a
null path or version is a value like others; a text of any length is one blob; an empty table gives an empty table.  The result has exactly the key columns, blob and findings, so clashing extra columns
cannot disturb it.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import shared_root


class Rule(NamedTuple):
    """kind; pattern (Java); smallest length; the group that length is of, 0 for the match."""

    kind: str
    pattern: str
    least: int
    group: int = 0


#: Base rules first, in the order that ranks spans with one start; the pattern matches first, then short ones are dropped.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
)
RULES = BASE + EXTRA
ENTRIES_DDL = "blob string, rules_version string, findings array<struct<start:int,kind_rank:int,end:int,kind:string>>"


def version_of(rules: tuple[Rule, ...]) -> str:
    """The digest of the rules in their order."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame, rules_version: str) -> DataFrame:
    """(blob, content) of one carrier row for each blob without a ledger entry for this rule version.

    Carriers are chosen on (blob, row tag) alone, so text is moved once and never aggregated."""
    keyed = versions.select(blob_of(F.col("content")).alias("blob"), F.xxhash64("path", "version").alias("tag"), F.coalesce("content", F.lit("")).alias("content"))
    done = ledger.where(F.col("rules_version") == rules_version).select("blob")
    carriers = keyed.groupBy("blob").agg(F.min("tag").alias("tag")).join(done, "blob", "left_anti")
    return keyed.join(carriers.hint("shuffle_hash"), ["blob", "tag"], "left_semi").select("blob", "content")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of every blob, findings sorted by start, then by the order of the rules, null where there are none.

    A text is cut by each rule into (gap, match) lengths; a running sum per blob and rule gives the offsets."""
    text = F.col("content")

    def cuts(rank: int, rule: Rule) -> Column:
        size = lambda x: F.length(x)
        zipped = F.arrays_zip(
            F.transform(F.split(text, rule.pattern), size).alias("gap"),
            F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), size).alias("len"),
            F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), size).alias("size"),
        )
        made = F.transform(
            zipped,
            lambda m, i: F.struct(F.lit(rank).alias("kind_rank"), i.alias("at"), m["gap"].alias("gap"), m["len"].alias("len"), (m["size"] >= rule.least).alias("long")),
        )
        # the last gap has no match behind it
        return F.when(text.rlike(rule.pattern), F.filter(made, lambda m: m["len"].isNotNull())).otherwise(F.array().cast("array<struct<kind_rank:int,at:int,gap:int,len:int,long:boolean>>"))

    each = Window.partitionBy("blob", "kind_rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind_rank") + 1)
    found = F.sort_array(F.collect_list(F.when(F.col("long"), F.struct((F.col("end") - F.col("len")).alias("start"), "kind_rank", "end", kind.alias("kind")))))
    return (
        blobs.select("blob", F.explode_outer(F.concat(*[cuts(i, r) for i, r in enumerate(rules)])).alias("m"))
        .select("blob", "m.*")
        .dropDuplicates(["blob", "kind_rank", "at"])
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(each).cast("int"))
        .groupBy("blob")
        .agg(found.alias("findings"))
        .withColumn("findings", F.when(F.size("findings") > 0, F.col("findings")))
    )


class Ledger:
    """Entries (ENTRIES_DDL) as parquet under a folder that all executors reach; one appended part per update."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_root(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")

    def entries(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ENTRIES_DDL)
        return self.spark.read.schema(ENTRIES_DDL).parquet(self.folder)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the blobs of versions (path, version, content) that have no entry for these rules, append their entries, and
        return (path, version, blob, findings) for all versions, read from the ledger.

        Blobs without findings are entered too, so that they are not scanned again; their findings are null."""
        number = version_of(rules)
        scanned = scan_blobs(unseen_blobs(versions, self.entries(), number), rules)
        scanned.select("blob", F.lit(number).alias("rules_version"), "findings").write.mode("append").parquet(self.folder)
        known = self.entries().where((F.col("rules_version") == number) & F.col("findings").isNotNull()).select("blob", "findings")
        return versions.select("path", "version", blob_of(F.col("content")).alias("blob")).join(known, "blob", "left").select("path", "version", "blob", "findings")


def spans_text(findings: Column, ranks: int | None = None) -> Column:
    """kind:start:end, comma-joined; of the first so many rules only, where ranks is given."""
    chosen = findings if ranks is None else F.filter(findings, lambda f: f["kind_rank"] < ranks)
    return F.coalesce(F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","), F.lit(""))
