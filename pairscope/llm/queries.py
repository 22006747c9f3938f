"""The registered query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blob_ledger, chat_trie, contamination, line_dedup, near_dup, packing, toxicity, url_reputation, voronoi_knn, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality of the same id serves as the outcome of a labelled page."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_reputation.judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    findings = blob_ledger.Ledger(spark).update(versions)
    f = F.col("findings")
    count = lambda rank: F.coalesce(F.size(F.filter(f, lambda x: x["kind_rank"] == rank)), F.lit(0)).cast("long")
    return findings.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(blob_ledger.spans_text(f, len(blob_ledger.BASE)).cast("binary"), 256).alias("base_sha256"), blob_ledger.spans_text(f).alias("spans"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    read = warc.read_records(index, index._folder)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op3_url_reputation": op3_url_reputation,
    "op6_line_dedup": op6_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc": op9_warc,
}


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


QUERIES["op10_packing"] = op10_packing


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES["op7_near_dup"] = op7_near_dup


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


QUERIES |= {"op4_decontamination": op4_decontamination, "op1_toxicity": op1_toxicity}


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return chat_trie.read_back(chat_trie.prefix_blocks(turns))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return voronoi_knn.top_inner_products(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES |= {"op2_chat_format": op2_chat_format, "op5_topk": op5_topk}
