"""Chat formatting over a prefix tree: conversations that share initial turns share their tokens.

Conversations are gathered one per row and range-sorted by the hashes of their turns, which is the depth-first order of
their prefix tree.  A task walks its sorted range: the turns that a conversation shares with the one before it are
already written, only new turns are appended.  Output rows are blocks of bounded size; a block that starts inside a tree
repeats the open path, everything else stands once.

A block holds the tokens (code points of the formatted text) and per node: its stretch, its parent, the position id
of its first token (its depth in tokens, so positions continue from the parent's) and the attention intervals, the
stretches of its ancestors.  A token attends to these intervals and to earlier tokens of its own node.  tokenised() gives
the same blocks over the ids of a tokenizers file, in which positions and intervals are what a model takes.

Template: <|turn|>role<|text|>text<|end|>.  Control strings inside roles and texts are broken by a backslash after their
first character, backslashes are doubled; unescape() undoes both.

A conversation is one row, so it must fit a task; everything else, a first turn of a third of all conversations too, is
dealt by ranges of paths.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a null role or text is empty; rows that repeat
a turn are turns each; a null conv_id is one conversation; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates treat as control; none holds a backslash, none begins with another's last characters.
CONTROL = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
BROKEN = re.compile(r"\\(\\?)", re.S)
BLOCK_CHARS, BLOCK_LEAVES = 1 << 20, 20_000

NODE = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("attends", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("loss_begin", pa.int32()), ("loss_end", pa.int32())])
LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
BLOCKS = pa.schema([("tokens", pa.string()), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(LEAF))])
TOKENISED = pa.schema([("ids", pa.list_(pa.int32())), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(LEAF))])
BLOCKS_DDL = "tokens string, nodes array<struct<begin:int,end:int,parent:int,position:int,attends:array<struct<begin:int,end:int>>,loss_begin:int,loss_end:int>>, leaves array<struct<conv_id:long,node:int>>"


def escape(text: str) -> str:
    return CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return BROKEN.sub(lambda m: m[1], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The formatted turn and the stretch of its (escaped) text."""
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    return head + body + END, (len(head), len(head) + len(body))


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, text = turn[: -len(END)].partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def conversations_in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, path array<long>) range-sorted by path."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), path.alias("path"))


class Block:
    """Nodes under way: tokens, the open path of node numbers, finished rows."""

    def __init__(self):
        self.parts: list[str] = []
        self.size, self.nodes, self.leaves = 0, [], []

    def add(self, parent: int, role: str, text: str) -> int:
        written, (a, b) = format_turn(role, text)
        begin = self.size
        above = [] if parent < 0 else [*self.nodes[parent]["attends"], {"begin": self.nodes[parent]["begin"], "end": self.nodes[parent]["end"]}]
        if len(above) > 1 and above[-2]["end"] == above[-1]["begin"]:  # neighbours are one interval
            above[-2:] = [{"begin": above[-2]["begin"], "end": above[-1]["end"]}]
        position = 0 if parent < 0 else self.nodes[parent]["position"] + self.nodes[parent]["end"] - self.nodes[parent]["begin"]
        loss = (begin + a, begin + b) if role == "assistant" else (begin, begin)
        self.nodes.append({"begin": begin, "end": begin + len(written), "parent": parent, "position": position, "attends": above, "loss_begin": loss[0], "loss_end": loss[1]})
        self.parts.append(written)
        self.size += len(written)
        return len(self.nodes) - 1

    def row(self) -> dict:
        return {"tokens": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def prefix_blocks(turns: DataFrame, block_chars: int = BLOCK_CHARS, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """Blocks (BLOCKS_DDL) of the prefix tree of turns (conv_id, turn, role, text)."""
    small_batches(turns.sparkSession)
    ordered = conversations_in_order(turns)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before, open_path = Block(), [], []
        for batch in batches:
            for ident, talk in zip(batch.column("conv_id").to_pylist(), batch.column("turns")):
                talk = [(t["role"], t["text"]) for t in talk.as_py()]
                if block.size >= block_chars or len(block.leaves) >= block_leaves:
                    yield pa.RecordBatch.from_pylist([block.row()], schema=BLOCKS)
                    block, before, open_path = Block(), [], []
                shared = 0
                while shared < min(len(talk), len(before)) and talk[shared] == before[shared]:
                    shared += 1
                del open_path[shared:]
                for role, text in talk[shared:]:
                    open_path.append(block.add(open_path[-1] if open_path else -1, role, text))
                block.leaves.append({"conv_id": ident, "node": open_path[-1] if open_path else -1})
                before = talk
        if block.leaves:
            yield pa.RecordBatch.from_pylist([block.row()], schema=BLOCKS)

    return dealt.select("conv_id", "turns").mapInArrow(task, BLOCKS_DDL)


def tokenised(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """(ids, nodes, leaves) of blocks: each node's head, text and end are encoded by themselves, once, depth-first; begin,
    end, position, attends, loss_begin and loss_end count token ids.  tokenizer is the path of a tokenizers file."""
    from .packing import Encoder

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                text, made, parts, size = row["tokens"], [], [], 0
                for n in row["nodes"]:
                    under_loss = n["loss_end"] > n["loss_begin"]
                    cuts = [n["begin"], n["loss_begin"], n["loss_end"], n["end"]] if under_loss else [n["begin"], n["end"]]
                    ids = [encode(text[a:b]) for a, b in zip(cuts, cuts[1:])]
                    ends = [size]
                    for part in ids:
                        ends.append(ends[-1] + len(part) // 4)
                    above, position = [], 0
                    if n["parent"] >= 0:
                        up = made[n["parent"]]
                        position = up["position"] + up["end"] - up["begin"]
                        above = [*up["attends"], {"begin": up["begin"], "end": up["end"]}]
                        if len(above) > 1 and above[-2]["end"] == above[-1]["begin"]:
                            above[-2:] = [{"begin": above[-2]["begin"], "end": above[-1]["end"]}]
                    made.append({"begin": size, "end": ends[-1], "parent": n["parent"], "position": position, "attends": above, "loss_begin": ends[1] if under_loss else size, "loss_end": ends[2] if under_loss else size})
                    parts += ids
                    size = ends[-1]
                ids = np.frombuffer(b"".join(parts), np.uint32).astype(np.int32)
                yield pa.RecordBatch.from_pylist([{"ids": ids, "nodes": made, "leaves": row["leaves"]}], schema=TOKENISED)

    return blocks.mapInArrow(task, BLOCKS_DDL.replace("tokens string", "ids array<int>"))


def read_back(blocks: DataFrame) -> DataFrame:
    """Per conversation, from its block alone: turns, digest of the turns, digest and size of the text under loss."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, nodes, rows = row["tokens"], row["nodes"], []
                for leaf in row["leaves"]:
                    chain, at = [], leaf["node"]
                    while at >= 0:
                        chain.append(nodes[at])
                        at = nodes[at]["parent"]
                    chain.reverse()
                    formatted = "".join(tokens[i["begin"] : i["end"]] for i in ([*chain[-1]["attends"], chain[-1]] if chain else []))
                    turns = parse_turns(formatted)
                    loss = "".join(unescape(tokens[n["loss_begin"] : n["loss_end"]]) for n in chain)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((leaf["conv_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return blocks.mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
