"""Line deduplication with DataFrame functions only.

Every line is normalised (ASCII blanks stripped, A-Z lowered) and hashed to 128 bits; distinct documents are counted
per hash; a line found in enough documents is kept only in the document with the largest id.  Lines travel as
(id, position, hash), the text itself is moved once, when documents meet their list of dropped positions.  The common
hashes are a table of their own, so a line that a third of all documents hold is dealt to many tasks when lines meet it.

Defined cases: a null or empty text is one empty line (returned as an empty text); a null id counts as one document below
all others; rows that repeat an id are one document for the count and each row keeps its own lines; an empty table gives
an empty table.  Columns named n_lines or n_dropped in the input are replaced, all other columns are passed through under
any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh_names, stored

NULL_ID = -(2**63)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, tag, pos, a, b): one row per line whose normalised form has at least min_chars code points."""
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(F.col(text_col)).alias("tag"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"),
    )
    keys = lines.select("id", "tag", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("id", "tag", "pos", F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """docs with text_col reduced to its kept lines, plus n_lines and n_dropped (long)."""
    keys = line_keys(docs, id_col, text_col, min_chars)
    common = keys.groupBy("a", "b").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("home")).where(F.col("docs") >= min_docs)
    common = stored(common.select("a", "b", "home"), "common-lines")
    names = fresh_names([*docs.columns, "n_lines", "n_dropped"], "id", "tag", "drops", "lines")
    ident, tag, drop, lines = names
    drops = (
        keys.join(common, ["a", "b"])
        .where("id < home")
        .groupBy(F.col("id").alias(ident), F.col("tag").alias(tag))
        .agg(F.sort_array(F.collect_set("pos")).alias(drop))
    )
    passed = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    keyed = docs.select(*passed, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias(ident), F.xxhash64(F.col(text_col)).alias(tag))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = keyed.join(drops.hint("shuffle_hash"), [ident, tag], "left").withColumn(lines, F.split(text, "\n"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col(drop)),
        F.concat(F.col(drop), F.array(F.size(lines))),
        lambda s, e: F.slice(F.col(lines), s + 2, e - s - 1),
    )
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in passed],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
