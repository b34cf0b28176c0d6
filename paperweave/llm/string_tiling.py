"""Operator 1: benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import give_back, small_batches, table
from paperweave.session import Rounds

SEED_TOKENS = 5
MIN_COVERAGE = 0.5
FILTER_BITS = 22
TOKEN = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15 | 1
TOKEN_CACHE = 200_000


def token_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64-bit hash of each lower-cased word; `known` remembers words within a task."""
    words = TOKEN.findall((text or "").lower())
    if len(known) > TOKEN_CACHE:
        known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of every run of `length` tokens."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(BASE) + tokens[k:k + n]
        return out ^ out >> np.uint64(29)


def benchmark_seeds(benchmark: DataFrame, length: int = SEED_TOKENS) -> DataFrame:
    """(item_id, item_tokens, at, seed): every run of `length` tokens of every item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                tokens = token_hashes(text, known)
                seeds = rolling(tokens, length).view(np.int64)
                yield pd.DataFrame({"item_id": item, "item_tokens": len(tokens), "at": np.arange(len(seeds)), "seed": seeds})

    return benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").dropDuplicates().mapInPandas(
        cut, "item_id long, item_tokens long, at long, seed long"
    )


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit per value of the low FILTER_BITS of seeds: 512 KB, whatever the number of items."""
    low = F.col("seed").bitwiseAND((1 << FILTER_BITS) - 1)
    words = seeds.select((low / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(seed, 64) as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def document_seeds(docs: DataFrame, bits: np.ndarray, length: int = SEED_TOKENS) -> DataFrame:
    """(doc_id, place, seed) of the runs in documents that the filter lets through.

    A row of its own for every such run of whole texts. The filter only saves
    rows: a false hit finds no partner in the join that follows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = np.unpackbits(shared.value).astype(bool)
        low, known = np.uint64((1 << FILTER_BITS) - 1), {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                seeds = rolling(token_hashes(text, known), length)
                at = np.flatnonzero(listed[(seeds & low).astype(np.int64)])
                if len(at):
                    out.append(pd.DataFrame({"doc_id": doc, "place": at, "seed": seeds[at].view(np.int64)}))
            if out:
                yield pd.concat(out, ignore_index=True)
        known.clear()
        give_back()

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(
        cut, "doc_id long, place long, seed long"
    )


def tiles(places: np.ndarray, ats: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document place, item place, tokens) of non-overlapping matches, longest first.

    Equal seeds that follow each other on a diagonal are one maximal match. The
    longest match is marked; what marks have cut of others goes back in line if
    at least `length` tokens of it are free, until none is left.
    """
    order = np.lexsort((places, places - ats))
    p, d = places[order], (places - ats)[order]
    cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1), [True])))
    queue = [(-(int(p[b - 1]) - int(p[a]) + length), int(p[a]), int(p[a] - d[a])) for a, b in zip(cut[:-1], cut[1:])]
    heapq.heapify(queue)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    found = []
    while queue:
        size, place, at = heapq.heappop(queue)
        free = [k for k in range(-size) if place + k not in in_doc and at + k not in in_item]
        if len(free) == -size:
            found.append((place, at, -size))
            in_doc.update(range(place, place - size))
            in_item.update(range(at, at - size))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= length:
                    heapq.heappush(queue, (-(k - start), place + free[start], at + free[start]))
                start = k
    return found


def _tile(length: int):
    def tile(pairs: pd.DataFrame) -> pd.DataFrame:
        found = tiles(pairs["place"].to_numpy(), pairs["at"].to_numpy(), length)
        covered = sum(size for _, _, size in found)
        item_tokens = int(pairs["item_tokens"].iloc[0])
        return pd.DataFrame({
            "doc_id": [pairs["doc_id"].iloc[0]], "item_id": [pairs["item_id"].iloc[0]], "tiles": [len(found)],
            "covered": [covered], "item_tokens": [item_tokens], "coverage": [covered / item_tokens],
        })

    return tile


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, length: int = SEED_TOKENS
) -> DataFrame:
    """(doc_id, item_id, tiles, covered, item_tokens, coverage) of pairs whose tiles cover enough of the item.

    Tokens are lower-cased words. Tiles are matches of at least `length` tokens
    in any order, so reordered passages count; `coverage` is the covered share
    of the item's tokens, and pairs below `min_coverage` are left out. Items
    shorter than `length` tokens cannot be told from common phrases and match
    nothing; nor do null or empty texts, and rows with a null id. Repeated rows
    of a document or an item count once; other columns are ignored.

    Documents and items meet in an equi-join on 64-bit hashes of token runs.
    """
    seeds = benchmark_seeds(benchmark, length)
    hits = Rounds(docs.sparkSession, "tiling").cut(document_seeds(docs, _filter(seeds), length).distinct())
    pairs = hits.join(seeds, "seed")
    possible = pairs.groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("n"), F.max("item_tokens").alias("of"))
    # k distinct seeds cover at most k x length tokens, so most chance pairs need no tiling.
    possible = possible.where(F.col("n") * length >= F.col("of") * min_coverage).select("doc_id", "item_id")
    return (
        pairs.join(possible, ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id").applyInPandas(
            _tile(length), "doc_id long, item_id long, tiles long, covered long, item_tokens long, coverage double"
        ).where(F.col("coverage") >= min_coverage)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
