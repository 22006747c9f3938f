"""Corpus pipeline over documents: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the first four return the columns
of documents, and any others, with their decisions applied, the last returns the packed pieces with their token ids.

Defined cases, in every stage: null and empty texts are kept as documents without words (line dedup makes a null text an
empty one); a null id is kept by all filters but by line dedup's own rule, where it counts as one document below all
others; nulls in other columns, extra columns and columns of clashing names pass through, but n_lines and n_dropped, which
line dedup takes for its counts; rows that repeat an id are judged each, except that near-dedup takes an id as one
document and drops all its rows or none; of equal documents the smallest id stays; an empty table gives an empty table;
texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm import contamination, line_dedup, near_dup, packing, toxicity
from pairscope.llm.common import discard, stored
from pairscope.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in 5 documents or more stay in one; a document of dropped lines only goes."""
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return left.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, at five words and a similarity of 0.8."""
    return near_dup.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Nearest examples, MinHash and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; of the stored stages only the last outlives the call."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
