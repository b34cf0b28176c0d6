"""Operator 2: budgeted chat windows with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm.common import small_batches, table
from paperweave.llm.token_files import encoder_of
from paperweave.session import Rounds

TOKENIZER = "byte_bpe_50k.json"
BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = 512
BLOCK_TURNS = 256
SYSTEM, HISTORY, OWN = 0, 1, 2

SPECIAL = re.compile(r"[\\<|\[]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<\|((?:\\.|[^\\|])*)\|>((?:\\.|[^\\<])*)</s>", re.S)
WINDOWS = ("conv_id long, block long, window int, text string, repeated int, "
           "loss array<struct<start:int,end:int>>")
WINDOW_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("text", pa.string()),
    ("repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")
DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
OUT_ROWS = 500


def escape(text: str) -> str:
    """Texts hold no control string afterwards: its first character is always marked."""
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Turn(NamedTuple):
    turn: int
    role: str
    text: str
    tokens: int


def turn_tokens(tokenizer: str):
    """Column function of (role, text): tokens of the formatted turn, each turn encoded by itself."""

    @F.pandas_udf("long")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for roles, texts in batches:
            turns = pa.array([f"<|{escape(r)}|>{escape(t)}</s>" for r, t in zip(roles, texts)], pa.large_string())
            yield pd.Series(np.fromiter(map(len, encoder_of(tokenizer).encode(turns)), np.int64, len(turns)))

    return count


def _window(turns: list[tuple], fresh: int) -> tuple[str, list[dict]]:
    """Formatted text of turns and the loss spans of those from `fresh` on."""
    out, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"<|{escape(role)}|>", escape(text)
        if k >= fresh and role == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += (head, body, "</s>")
        at += len(head) + len(body) + 4
    return "".join(out), spans


def _cut(rows: Iterable[tuple], budget: int) -> Iterator[tuple[list[Turn], list[Turn]]]:
    """(repeated turns, new turns) of each window of one block, from (kind, turn, role, text, tokens) in order.

    Running sums of tokens choose the spans while the turns stream by, so no more
    than one window is held, whatever the number of turns.
    """
    system, past = None, deque(maxlen=HISTORY_TURNS)
    lead, new, used = [], [], 0
    for kind, *rest in rows:
        turn = Turn(*rest)
        if kind == SYSTEM:
            system = turn
            continue
        if kind == OWN:
            if new and used + turn.tokens > budget:
                yield lead, new
                new = []
            if not new:
                lead = list(past)
                while lead and sum(t.tokens for t in lead) > HISTORY_TOKENS:
                    lead.pop(0)
                head = [system] if system else []
                while lead and sum(t.tokens for t in _headed(head, lead)) + turn.tokens > budget:
                    lead.pop(0)
                lead = _headed(head, lead)
                used = sum(t.tokens for t in lead)
            new.append(turn)
            used += turn.tokens
            system = system or (turn if turn.role == "system" else None)
        past.append(turn)
    if new:
        yield lead, new


def _headed(system: list[Turn], history: list[Turn]) -> list[Turn]:
    """The history behind the system turn, which stands once."""
    return history if system and system[0] in history else system + history


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _history(rows: DataFrame) -> DataFrame:
    """The turns that a block's first window may repeat, as rows of kind HISTORY of that block.

    A block hands its last HISTORY_TURNS turns on. As it has one at least, the
    blocks that many places before hold all that a block may repeat. Turns too
    long to be repeated travel without their text.
    """
    spare = F.col("tokens") > HISTORY_TOKENS
    last = Window.partitionBy("conv_id", "block").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    tails = (
        rows.withColumn("back", F.row_number().over(last)).where(F.col("back") <= HISTORY_TURNS)
        .withColumn("text", F.when(spare, "").otherwise(F.col("text")))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("back", "turn", "role", "text", "tokens"))).alias("tail"))
    )
    order = Window.partitionBy("conv_id").orderBy("block")
    empty = F.array().cast(tails.schema["tail"].dataType)
    before = F.concat(*[F.coalesce(F.lag("tail", k).over(order), empty) for k in range(1, HISTORY_TURNS + 1)])
    near = tails.withColumn("before", F.slice(before, 1, HISTORY_TURNS)).select("conv_id", "block", F.explode("before").alias("t"))
    return near.select("conv_id", "block", F.lit(HISTORY).alias("kind"), "t.turn", "t.role", "t.text", "t.tokens")


def chat_windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET) -> DataFrame:
    """Windows (conv_id, block, window, text, repeated, loss) of conversations given by turn.

    Turns of a conversation stand in order of (turn, role, text); null text and
    null role are empty, null turn comes first, repeated rows are turns of their
    own, a null conv_id is a conversation like any other. Each turn is new in
    exactly one window. A window holds the conversation's first system turn, up
    to HISTORY_TURNS turns of at most HISTORY_TOKENS tokens before its new ones,
    and as many whole new turns as the budget allows, one at least: a longer
    turn is never cut. `repeated` counts its leading turns that other windows
    hold as new; `loss` spans the text of new assistant turns only. Tokens are
    those of `tokenizer` (a file of a byte-level one) for the formatted turn.

    A conversation is cut every BLOCK_TURNS turn numbers, where a window ends,
    so the windows of a very long one are built by many tasks. The system turn
    and the history before a cut are carried over it. Rows that share one turn
    number, or have none, stream through one task a window at a time.
    """
    spark = turns.sparkSession
    small_batches(spark)
    count = turn_tokens(tokenizer or public_tokenizers.path(TOKENIZER))
    rows = Rounds(spark, "chat").cut(turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)).withColumn("tokens", count("role", "text")))
    heads = (
        rows.where(F.col("role") == "system").groupBy("conv_id")
        .agg(F.min(F.struct("turn", "text", "tokens")).alias("first"), F.min("block").alias("from_block"))
    )
    later = (
        rows.select("conv_id", "block").distinct().join(heads.withColumnRenamed("conv_id", "of"),
                                                        F.col("conv_id").eqNullSafe(F.col("of")))
        .where(F.col("block") > F.col("from_block"))
        .select("conv_id", "block", F.lit(SYSTEM).alias("kind"), F.col("first.turn").alias("turn"),
                F.lit("system").alias("role"), F.col("first.text").alias("text"), F.col("first.tokens").alias("tokens"))
    )
    names = ["conv_id", "block", "kind", "turn", "role", "text", "tokens"]
    dealt = (
        rows.withColumn("kind", F.lit(OWN)).select(names).unionByName(later).unionByName(_history(rows))
        .repartition("conv_id", "block").sortWithinPartitions(names[:-1])
    )

    def build(rows: Iterable[tuple]) -> Iterator[dict]:
        for (conv, block), group in groupby(rows, key=lambda r: r[:2]):
            for k, (lead, new) in enumerate(_cut((r[2:] for r in group), budget)):
                text, loss = _window([(t.role, t.text) for t in lead + new], len(lead))
                yield {"conv_id": conv, "block": block, "window": k, "text": text, "repeated": len(lead), "loss": loss}

    return dealt.mapInArrow(lambda batches: _batched(build(_rows(batches, names)), WINDOW_SCHEMA), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows hold, one row per conversation, parsed from their text alone.

    Streams a conversation's windows in order with two running hashes, so memory
    is one window. A digest over an ordered text is sequential by nature: the
    windows of one conversation pass through one task here, not in the operator.
    """
    names = ["conv_id", "text", "repeated", "loss"]
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").select(names)

    def digest(rows: Iterable[tuple]) -> Iterator[dict]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, text, repeated, spans in group:
                chars += len(text)
                for k, m in enumerate(TURN.finditer(text)):
                    if k >= repeated:
                        n += 1
                        turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    under = unescape(text[s["start"]:s["end"]])
                    loss_chars += len(under)
                    loss.update(under.encode("utf-8", "surrogatepass"))
            yield {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                   "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    return ordered.mapInArrow(lambda batches: _batched(digest(_rows(batches, names)), DIGEST_SCHEMA), DIGESTS)


TRAP = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)],
                                 "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(turns.unionByName(trap)))
