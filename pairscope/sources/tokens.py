"""Symbol sequences from text: byte and word tokenizers, dense positions, record blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import stored

#: Fixed value: runs of letters, runs of digits, single other characters.
WORD = r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"


def byte_tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, raw): one row per UTF-8 byte, raw 0..255."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text_col, "UTF-8")), F.lit(".."), F.lit(0))
    return texts.select(F.col(id_col).alias("id"), F.posexplode(pairs).alias("pos", "h")).select("id", "pos", F.conv("h", 16, 10).cast("int").alias("raw"))


def word_tokens(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, word)."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias("pos", "word"))


def dense_tokens(texts: DataFrame, id_col: str, text_col: str, gran: str = "word", out: str = "t") -> DataFrame:
    """(id, pos, raw or word, t): byte or word tokens with a dense global ordinal by (id, pos); ids must not repeat.

    pos is the place in the text already, so only the number of tokens per text is summed in id order, over range
    partitions; texts meet their offset before they are cut, and tokens are never shuffled or sorted."""
    from ..operators.ranks import sum_before

    make = byte_tokens if gran == "byte" else word_tokens
    named = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = named.select("id", F.coalesce(F.octet_length("text") if gran == "byte" else F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    placed = named.join(sum_before(sizes, ["id"], "n").select("id", "before"), "id")
    cut = make(placed.select(F.struct("id", "before").alias("key"), "text"), "key", "text").withColumnRenamed("id", "key")
    rest = [c for c in cut.columns if c not in ("key", "pos")]
    return cut.select(F.col("key.id").alias("id"), "pos", *rest, (F.col("key.before") + F.col("pos")).cast("long").alias(out))


def first_seen_ids(tokens: DataFrame, word_col: str = "word", t_col: str = "t") -> DataFrame:
    """(word, raw): ids in the order of first appearance, ranked over range partitions."""
    from ..operators.ranks import global_rank

    firsts = tokens.groupBy(word_col).agg(F.min(t_col).alias("first"))
    return global_rank(firsts, ["first"], "__r").select(word_col, (F.col("__r") - 1).cast("int").alias("raw"))


def vocabulary(tokens: DataFrame, raw_col: str, size: int, train) -> DataFrame:
    """(raw, tok): the size-1 most frequent symbols of the training side, ties by symbol; tok counts from 1."""
    counts = tokens.where(train).groupBy(raw_col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), raw_col).limit(size - 1)
    return top.select(raw_col, F.row_number().over(Window.orderBy(F.desc("n"), raw_col)).alias("tok"))


def apply_vocabulary(tokens: DataFrame, vocab: DataFrame, raw_col: str) -> DataFrame:
    """tokens with tok, 0 for symbols outside the vocabulary; the vocabulary has a bounded size by construction."""
    return tokens.join(F.broadcast(vocab), raw_col, "left").withColumn("tok", F.coalesce("tok", F.lit(0)))


def records(tokens: DataFrame, fields: int, limit: int, seed: int, size: int, t_col: str = "t", raw_col: str = "word", train_share: float = 0.7) -> DataFrame:
    """Blocks of fields+2 consecutive symbols as rows (rec, f0..): positions 0..fields-2 and fields+1.

    Blocks are ordered by hash, the first `limit` are kept, the first share of them trains the vocabulary.  y is the
    parity of the first and last field."""
    from ..functions.hashing import digest

    width = fields + 2
    blocks = tokens.select((F.col(t_col) - F.col(t_col) % width).alias("b"), (F.col(t_col) % width).alias("p"), F.col(raw_col).alias("raw"))
    full = blocks.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == width).select((F.col("b") / width).cast("long").alias("block"), "b")
    chosen = full.orderBy(digest(seed, "record", F.col("block")), "block").limit(limit)
    ranked = chosen.select("b", (F.row_number().over(Window.orderBy(digest(seed, "record", F.col("block")), "block")) - 1).alias("rec"))
    ranked = stored(ranked, "blocks")
    total = ranked.count()
    # at most `limit` blocks are broadcast; their symbols are stored, the stream is read twice in all
    held = stored(blocks.where((F.col("p") < fields - 1) | (F.col("p") == fields + 1)).join(F.broadcast(ranked), "b"), "held")
    vocab = vocabulary(held, "raw", size, F.col("rec") < int(total * train_share))
    coded = apply_vocabulary(held, vocab, "raw")
    wide = coded.groupBy("rec").agg(*[F.max(F.when(F.col("p") == (k if k < fields - 1 else fields + 1), F.col("tok"))).alias(f"f{k}") for k in range(fields)])
    return wide.withColumn("y", ((F.col("f0") + F.col(f"f{fields - 1}")) % 2).cast("int"))
