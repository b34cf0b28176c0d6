"""Operator 8: scoring texts by a bigram model with deleted interpolation.

Counts travel as sorted arrays instead of a row per n-gram. The tokens of some
thousand documents make a block. Each block asks for the counts of its distinct
n-grams: the sorted keys are cut into ranges, one range of up to FAN million
tokens of blocks meets in one task, which adds the counts up and answers every
block in its own order. Beyond that many blocks the sums of a group of blocks
are cut into finer ranges and ask in their turn, level by level, so a block
asks at most FAN ranges and a task hears a bounded number of blocks at any size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import fold_of, small_batches, table
from paperweave.session import Rounds

FOLDS, HELD_OUT, TUNING = 7, 2, 3
BLOCK_TOKENS = 1_000_000
RANGE_TOKENS = 1 << 20
FAN = 256
ASKS, TUNES, FITS = 0, 1, 2
STEP = 8
UNSEEN = -10_000
EM_ROUNDS = 100

END = xxhash.xxh64_intdigest(b"\n")
MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = ("block string, kind int, tokens long, doc_ids binary, sizes binary, words binary, stream binary")
KEYS = "block string, n int, bucket long, keys binary, fits binary, tunes binary"
COUNTS = "block string, n int, bucket long, fits binary, tunes binary"
ANSWERS = COUNTS + ", total long, fit_total long, types long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return values.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes) -> np.ndarray:
    dtype = np.dtype(data[:3].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Nothing where all are zero."""
    top = counts.max(initial=0)
    return _pack(counts.astype("<u4" if top < 1 << 32 else "<u8")) if top else b""


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    return _unpack(data).astype(np.int64) if data else np.zeros(n, np.int64)


def _block(doc_ids: list, sizes: list, words: dict, stream: list, kind: int) -> dict:
    """One block; words are numbered by falling frequency, so high bytes are mostly zero."""
    stream = np.array(stream, np.int64)
    count = np.bincount(stream, minlength=len(words))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    hashes = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return {
        "block": uuid.uuid4().hex, "kind": kind, "tokens": len(stream),
        "doc_ids": np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        "sizes": np.array(sizes, "<u4").tobytes(), "words": hashes[order].astype("<u8").tobytes(),
        "stream": _pack(rank[stream]),
    }


def token_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents (doc_id, text, kind) as blocks of one kind: ids, sizes, distinct words, token stream."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for batch in batches:
            columns = (batch["kind"].tolist(), batch["doc_id"].tolist(), batch["no_id"].tolist(), batch["text"])
            for kind, doc_id, no_id, text in zip(*columns):
                ids, sizes, words, stream = held.setdefault(kind, ([], [], {None: 0}, []))
                tokens = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
                stream += [words.setdefault(w, len(words)) for w in tokens]
                stream.append(0)
                ids.append(None if no_id else doc_id)
                sizes.append(len(tokens) + 1)
                if len(stream) >= block_tokens:
                    yield pd.DataFrame([_block(*held.pop(kind), kind)])
        for kind, rest in sorted(held.items()):
            yield pd.DataFrame([_block(*rest, kind)])

    small_batches(docs.sparkSession)
    # Ids reach pandas without nulls, which would turn them into floats.
    known = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
                        F.col("doc_id").isNull().alias("no_id"), "text", "kind")
    return known.mapInPandas(cut, BLOCKS)


class Block:
    """Tokens of a block and their distinct n-grams, in the order in which answers come."""

    def __init__(self, row):
        n = len(row["sizes"]) // 4
        self.doc_ids = np.frombuffer(row["doc_ids"][: 8 * n], "<i8")
        self.no_id = np.frombuffer(row["doc_ids"][8 * n:], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        words = np.frombuffer(row["words"], "<u8")
        self.stream = _unpack(row["stream"]).astype(np.int64)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[0] = np.flatnonzero(words == END)[0]
        pairs, self.pair_of, self.pair_count = np.unique(
            before * len(words) + self.stream, return_inverse=True, return_counts=True
        )
        self.before = before
        self.word_order = np.argsort(words, kind="stable")
        self.word_keys = words[self.word_order]
        self.word_count = np.bincount(self.stream, minlength=len(words))[self.word_order]
        with np.errstate(over="ignore"):
            keys = (words[pairs // len(words)] * MIX) ^ words[pairs % len(words)]
            keys = (keys ^ keys >> np.uint64(31)) * MIX
        keys ^= keys >> np.uint64(29)
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]
        self.pair_count = self.pair_count[self.pair_order]

    def answered(self, order: int, got: np.ndarray) -> np.ndarray:
        """Per token the answered count of its word (order 1) or of its pair (order 2)."""
        by_key, place = np.empty_like(got), self.word_order if order == 1 else self.pair_order
        by_key[place] = got
        return by_key if order == 1 else by_key[self.pair_of]


def _cut(block: str, n: int, keys: np.ndarray, fits: np.ndarray, tunes: np.ndarray, width: int) -> Iterator[tuple]:
    """Sorted keys and their counts as a row per range: keys with equal first `width` bits."""
    bucket = (keys >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for lo, hi in zip(edges[:-1], edges[1:]):
        steps = np.concatenate((keys[lo:lo + 1], keys[lo + 1:hi] - keys[lo:hi - 1]))
        yield block, n, int(bucket[lo]), _pack(steps), _pack_counts(fits[lo:hi]), _pack_counts(tunes[lo:hi])


def ask(blocks: DataFrame, width: int) -> DataFrame:
    """(block, n, bucket, keys, fits, tunes): the block's distinct n-grams by ranges of their keys."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = Block(row)
                out = []
                for n, keys, counts in ((1, b.word_keys, b.word_count), (2, b.pair_keys, b.pair_count)):
                    own = [counts if row["kind"] == kind else np.zeros_like(counts) for kind in (FITS, TUNES)]
                    out += _cut(row["block"], n, keys, *own, width)
                yield pd.DataFrame(out, columns=["block", "n", "bucket", "keys", "fits", "tunes"])

    return blocks.mapInPandas(asked, KEYS)


def _keys(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each row, all distinct ones in order, and the place of each row's keys among those."""
    parts = [np.cumsum(_unpack(k), dtype=np.uint64) for k in rows["keys"]]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return parts, ordered[new], group


def _summed(column: pd.Series, parts: list[np.ndarray], group: np.ndarray, n: int) -> np.ndarray:
    weights = np.concatenate([_unpack_counts(c, len(p)) for c, p in zip(column, parts)])
    return np.bincount(group, weights=weights, minlength=n).astype(np.int64)


def _replies(rows: pd.DataFrame, parts: list, group: np.ndarray, fits: np.ndarray, tunes: np.ndarray) -> Iterator[tuple]:
    """Each row's counts, in its order."""
    at = 0
    for block, n, bucket, part in zip(rows["block"], rows["n"], rows["bucket"], parts):
        own = group[at:at + len(part)]
        at += len(part)
        # always packed, so an answer tells its length
        yield block, n, bucket, *(_pack(c[own].astype("<u4" if c.max(initial=0) < 1 << 32 else "<u8")) for c in (fits, tunes))


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds one range up and answers each block that asked, in its order; totals go with the first."""
    rows = rows.sort_values("block")
    parts, keys, group = _keys(rows)
    fits, tunes = (_summed(rows[c], parts, group, len(keys)) for c in ("fits", "tunes"))
    out = pd.DataFrame(_replies(rows, parts, group, fits, tunes), columns=["block", "n", "bucket", "fits", "tunes"])
    first = np.arange(len(out)) == 0
    both = fits + tunes
    return out.assign(total=first * both.sum(), fit_total=first * fits.sum(), types=first * (both > 0).sum())


def _merge(width: int):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One group's sums of one range, cut into finer ranges."""
        parts, keys, group = _keys(rows)
        sums = (_summed(rows[c], parts, group, len(keys)) for c in ("fits", "tunes"))
        return pd.DataFrame(_cut(str(key[2]), int(key[0]), keys, *sums, width),
                            columns=["block", "n", "bucket", "keys", "fits", "tunes"])

    return merge


def _hand_down(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to a group's sums, dealt to each of its members in the member's order."""
    columns = ["block", "n", "bucket", "fits", "tunes"]
    if not len(rows):
        return pd.DataFrame(columns=columns)
    parts, _, group = _keys(rows)
    answers = answers.sort_values("bucket")
    totals = (np.concatenate([_unpack(c) for c in answers[name]]) for name in ("fits", "tunes"))
    return pd.DataFrame(_replies(rows, parts, group, *totals), columns=columns)


def count_ngrams(asked: DataFrame, units: int, width: int, limit: int, fan: int, rounds: Rounds) -> tuple[DataFrame, tuple]:
    """(block, n, bucket, fits, tunes) for every row of `asked`, and (total, fit_total, types) of all words.

    `units` is how many full blocks `asked` amounts to. Up to `fan` of them meet
    range by range. More are dealt to groups of about `fan`; the sums of a group
    are again a block of like size per range, and ask among the groups.
    """
    if units <= fan:
        answers = rounds.cut(asked.groupBy("n", "bucket").applyInPandas(_answer, ANSWERS))
        known = answers.where(F.col("n") == 1).agg(F.sum("total"), F.sum("fit_total"), F.sum("types")).first()
        return answers.select("block", "n", "bucket", "fits", "tunes"), tuple(x or 0 for x in known)
    groups = math.ceil(units / fan)
    finer = min(limit, width + int(math.log2(fan)))
    dealt = rounds.cut(asked.withColumn("into", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("string")))
    sums = dealt.groupBy("n", "bucket", "into").applyInPandas(_merge(finer), KEYS)
    above, known = count_ngrams(sums, groups, finer, limit, fan, rounds)
    of = above.select(F.col("block").alias("into"), "n", F.shiftright("bucket", finer - width).alias("of"), "bucket", "fits", "tunes")
    down = (
        dealt.select("block", "n", "bucket", "into", "keys").groupBy("n", "bucket", "into")
        .cogroup(of.groupBy("n", "of", "into")).applyInPandas(_hand_down, COUNTS)
    )
    return rounds.cut(down), known


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of log2 of its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _joined(answers: pd.DataFrame, b: Block, tuned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts per distinct word and per token's pair; of the fitting part only if not `tuned`."""
    answers = answers.sort_values(["n", "bucket"])
    out = []
    for n in (1, 2):
        own = answers[answers["n"] == n]
        got = sum(np.concatenate([_unpack(c) for c in own[name]]).astype(np.int64) for name in ("fits", "tunes")[:1 + tuned])
        out.append(b.answered(n, got))
    return out[0], out[1]


def _histogram(total: int):
    def histogram(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """How often held-out tokens have what log probability under each order, in steps of 1/STEP octave."""
        columns = ["bucket", "q2", "q1", "n"]
        if not len(tokens):
            return pd.DataFrame(columns=columns)
        b = Block(tokens.iloc[0])
        word, pair = _joined(answers, b, False)
        ctx, own = word[b.before], word[b.stream]
        with np.errstate(divide="ignore", invalid="ignore"):
            q2 = np.where(pair > 0, np.round(STEP * np.log2(pair / np.maximum(ctx, 1))), UNSEEN).astype(np.int64)
            q1 = np.where(own > 0, np.round(STEP * np.log2(own / max(total, 1))), UNSEEN).astype(np.int64)
        seen, n = np.unique(np.stack([context_bucket(ctx), q2, q1]), axis=1, return_counts=True)
        return pd.DataFrame({"bucket": seen[0], "q2": seen[1], "q1": seen[2], "n": n})

    return histogram


def learn_weights(held: pd.DataFrame, types: int) -> np.ndarray:
    """Weights of (bigram, unigram, uniform) per context bucket, by expectation-maximisation.

    Buckets that held-out tokens never show take the weights of all tokens together.
    """
    uniform = 1 / (types + 1)
    prob = lambda q: np.where(q > UNSEEN, np.exp2(q / STEP), 0.0)

    def em(rows: pd.DataFrame, bigram: bool) -> np.ndarray:
        p = np.stack([prob(rows["q2"].to_numpy()), prob(rows["q1"].to_numpy()), np.full(len(rows), uniform)])
        weight = np.array([0.4 if bigram else 0.0, 0.4, 0.2])
        weight /= weight.sum()
        n = rows["n"].to_numpy(float)
        for _ in range(EM_ROUNDS):
            share = weight[:, None] * p
            weight = (share / share.sum(axis=0) * n).sum(axis=1) / n.sum()
        return weight

    if not len(held):
        out = np.tile([0.4, 0.4, 0.2], (65, 1))
    else:
        out = np.tile(em(held, True), (65, 1))
        for bucket, rows in held.groupby("bucket"):
            out[int(bucket)] = em(rows, bucket > 0)
    out = np.maximum(out, 1e-9)
    out[0, 0] = 0
    return out / out.sum(axis=1, keepdims=True)


def _score(weights: np.ndarray, total: int, types: int):
    def score(tokens: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(tokens):
            return pd.DataFrame(columns=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        b = Block(tokens.iloc[0])
        word, pair = _joined(answers, b, True)
        ctx, own = word[b.before], word[b.stream]
        w = weights[context_bucket(ctx)]
        p = w[:, 0] * pair / np.maximum(ctx, 1) + w[:, 1] * own / max(total, 1) + w[:, 2] / (types + 1)
        starts = np.cumsum(b.sizes) - b.sizes
        add = lambda x: np.add.reduceat(x, starts)
        ids = pd.array(b.doc_ids, "Int64")
        ids[b.no_id] = pd.NA
        return pd.DataFrame({
            "doc_id": ids, "n_tokens": b.sizes, "n_known": add((own > 0).astype(np.int64)),
            "base_score": add(np.log10((own + 1) / (total + types + 1))), "score": add(np.log10(p)),
        })

    return score


def score_documents(
    docs: DataFrame, block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS, fan: int = FAN,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of (doc_id, text).

    Tokens are A-Z lower-cased words between ASCII blanks, then one end. The
    model mixes maximum-likelihood bigram and unigram estimates with a uniform
    one; the weights depend on the count of the context, in octaves, and come
    from expectation-maximisation on a held-out fold of the training rows, whose
    counts are added for scoring. `base_score` is the add-one unigram score.

    Training rows are those whose crc32(doc_id) modulo FOLDS is not HELD_OUT.
    Null text is empty: an end alone. A row without doc_id is scored but not
    learned from. Repeated rows count and are scored each; other columns are
    ignored. An untrained model scores every token as uniform. Sizes of blocks
    and ranges and the number of blocks that meet in a task change no result.
    """
    spark = docs.sparkSession
    rounds = Rounds(spark, "deleted-lm")
    fold = fold_of(F.col("doc_id"), FOLDS)
    kind = F.when(fold.isNull() | (fold == HELD_OUT), ASKS).when(fold == TUNING, TUNES).otherwise(FITS)
    blocks = rounds.cut(token_blocks(docs.select("doc_id", "text", kind.alias("kind")), block_tokens))
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    limit = max(0, math.ceil(math.log2(max(tokens, 1) / range_tokens)))
    width = min(limit, int(math.log2(fan)))
    units = math.ceil(tokens / block_tokens)
    counts, (total, fit_total, types) = count_ngrams(ask(blocks, width), units, width, limit, fan, rounds)
    held = blocks.where(F.col("kind") == TUNES)
    tuning = (
        held.groupBy("block").cogroup(counts.join(held.select("block"), "block", "left_semi").groupBy("block"))
        .applyInPandas(_histogram(fit_total), "bucket long, q2 long, q1 long, n long")
        .groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    )
    weights = learn_weights(tuning, types)
    scored = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_score(weights, total, types), SCORES)
    return scored.select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
