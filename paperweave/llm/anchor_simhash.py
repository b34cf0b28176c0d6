"""Operator 7: SimHash near-duplicates by anchor points of covering codes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import give_back, meet_in_blocks, small_batches, table
from paperweave.operators.components import connected_components
from paperweave.session import Rounds

SEED = 42
THRESHOLD = 4
BLOCK = 16_384
BUNDLE = 4
BATCH_TOKENS = 250_000
COMPARE_AT_ONCE = 2_000_000

# Two perfect codes: (bits, covering radius, syndrome bits). Golay's generator polynomial, as bits.
CODES = {"golay": (23, 3, 11), "hamming": (15, 1, 4)}
GOLAY_GENERATOR = 0b101011100011
# Parts of a fingerprint, as (first bit, code): a long reach in few anchors, or four even parts for wider thresholds.
GOLAY_PARTS = ((0, "golay"), (23, "golay"), (46, "hamming"))
HAMMING_PARTS = ((0, "hamming"), (15, "hamming"), (30, "hamming"), (45, "hamming"))

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle of lower-cased words; the whole sequence when there are fewer words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1:].tolist())]


def simhash(texts: Sequence[str | None], words: int, seed: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 where over half the shingle hashes have it; 0 without words."""
    return majority((np.array(shingle_hashes(t, words, seed), np.uint64) for t in texts), len(texts))


def majority(hashes: Iterable[np.ndarray], count: int) -> np.ndarray:
    """For each of `count` arrays of hashes the bits that over half of them have.

    Bits are counted through the eight bytes of a hash: one histogram of byte
    values per text and place, times the bits of each value.
    """
    out = np.zeros(count, np.uint64)

    def settle(at: int, group: list[np.ndarray]) -> None:
        n = np.array([len(g) for g in group])
        flat = np.concatenate(group)
        owner = np.repeat(np.arange(len(group)), n) * 256
        places = flat.astype(">u8").view(np.uint8).reshape(-1, 8)
        result = np.zeros((len(group), 8), np.uint8)
        for k in range(8):
            seen = np.bincount(owner + places[:, k], minlength=len(group) * 256).reshape(-1, 256)
            result[:, k] = np.packbits((seen @ _BITS) * 2 > n[:, None], axis=1)[:, 0]
        out[at:at + len(group)] = result.reshape(-1).view(">u8")

    held, size, start = [], 0, 0
    for i, own in enumerate(hashes):
        held.append(own)
        size += len(own)
        if size >= BATCH_TOKENS or len(held) >= 2_000:
            settle(start, held)
            held, size, start = [], 0, i + 1
    if held:
        settle(start, held)
    return out


def fingerprints(text: Column, words: int = 4, seeds: Sequence[int] = (SEED,)) -> Column:
    """Signed 64-bit SimHashes of whole texts, one per seed."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            each = np.stack([simhash(texts, words, seed).view(np.int64) for seed in seeds], axis=1)
            yield pd.Series(list(each), dtype=object)

    return run(text)


def shares(threshold: int, parts: Sequence) -> list[int]:
    """How far apart two words may be in each part, so that words within `threshold` meet in one at least.

    If every part differed by more than its share, the words would differ by
    more than the shares' sum plus one less than the number of parts.
    """
    out = [0] * len(parts)
    for k in range(max(0, threshold - len(parts) + 1)):
        out[k % len(parts)] += 1
    return out


@lru_cache
def unit_syndromes(code: str) -> np.ndarray:
    """Syndrome of each single bit."""
    if code == "hamming":
        return np.arange(1, 16, dtype=np.int64)

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << (bit - 11)
        return word

    return np.array([rest(1 << b) for b in range(23)], np.int64)


def syndrome(words: np.ndarray, code: str) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for b, unit in enumerate(unit_syndromes(code)):
        out ^= np.where(words >> b & 1, unit, 0)
    return out


@lru_cache
def ball(bits: int, radius: int) -> tuple[int, ...]:
    """All words of at most `radius` ones, lightest first."""
    words, layer = [0], [0]
    for _ in range(radius):
        layer = sorted({w | 1 << b for w in layer for b in range(bits) if not w >> b & 1})
        words += layer
    return tuple(words)


@lru_cache
def ways_to_anchors(code: str, share: int) -> np.ndarray:
    """For each syndrome the changes that lead to a codeword within covering radius plus share.

    The lightest comes first, and leads to the nearest codeword; -1 fills up.
    """
    bits, radius, checks = CODES[code]
    words = np.array(ball(bits, radius + share), np.int64)
    of = syndrome(words, code)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=1 << checks)
    out = np.full((1 << checks, counts.max()), -1, np.int64)
    starts = np.cumsum(counts) - counts
    for s, (at, n) in enumerate(zip(starts, counts)):
        out[s, :n] = words[order[at:at + n]]
    return out


def anchors_of(fps: np.ndarray, threshold: int, parts: Sequence) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: (part, row, anchor, is the row's nearest) of every anchor within radius and share."""
    for part, ((first, code), share) in enumerate(zip(parts, shares(threshold, parts))):
        word = (fps >> np.uint64(first) & np.uint64((1 << CODES[code][0]) - 1)).astype(np.int64)
        ways = ways_to_anchors(code, share)[syndrome(word, code)]
        rows, at = np.nonzero(ways >= 0)
        yield part, rows, word[rows] ^ ways[rows, at], at == 0


def _place(threshold: int, parts: Sequence):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 5_000):
                own = batch.iloc[lo:lo + 5_000]
                nodes, all_fps = own["node"].to_numpy(), np.array(own["fps"].tolist(), np.int64).reshape(len(own), -1)
                for of in range(all_fps.shape[1]):
                    for part, rows, anchor, home in anchors_of(all_fps[:, of].view(np.uint64), threshold, parts):
                        yield pd.DataFrame({
                            "cell": (anchor << 3 | part) << 3 | of, "node": nodes[rows], "home": home,
                            **{f"f{k}": all_fps[rows, k] for k in range(all_fps.shape[1])},
                        })

    return place


def star_edges(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes, over chunks of links."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _linked(of: int, fps: np.ndarray, home: np.ndarray, half: np.ndarray, reach: int, most: float):
    """Links between the members at home and all members of one block, in chunks."""
    own = np.ascontiguousarray(fps[:, of])
    across = half.min() != half.max()
    homes = np.flatnonzero(home)
    for lo in range(0, len(homes), max(1, COMPARE_AT_ONCE // len(own))):
        rows = homes[lo:lo + max(1, COMPARE_AT_ONCE // len(own))]
        close = np.bitwise_count(own[rows, None] ^ own[None, :]) <= reach
        if across:
            close &= half[rows, None] != half[None, :]
        a, b = np.nonzero(close)
        a = rows[a]
        keep = a != b
        if fps.shape[1] > 1:
            keep &= np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= most
        yield a[keep], b[keep]


def _compare(reach: int, count: int, most: float):
    def compare(members: pd.DataFrame) -> pd.DataFrame:
        """Links of a bundle of blocks as a star per local component; pairs never leave the task."""
        members = members.sort_values(["cell", "block", "node"], kind="stable")
        cell, block = members["cell"].to_numpy(), members["block"].to_numpy()
        nodes, half, home = members["node"].to_numpy(), members["half"].to_numpy(), members["home"].to_numpy(bool)
        fps = np.stack([members[f"f{k}"].to_numpy(np.int64).view(np.uint64) for k in range(count)], axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]), [True])))
        source, target = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                links = _linked(int(cell[lo] & 7), fps[lo:hi], home[lo:hi], half[lo:hi], reach, most)
                root = star_edges(links, hi - lo)
                off = np.flatnonzero(root != np.arange(hi - lo))
                source.append(nodes[lo:hi][off])
                target.append(nodes[lo:hi][root[off]])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"source": np.concatenate(source or none), "target": np.concatenate(target or none)})

    return compare


def most_bits(similarity: float, bits: int, errors: float = 1) -> float:
    """Differing bits of two texts of that Jaccard similarity, plus so many standard errors of the estimate.

    A bit of two SimHashes differs with the angle between the shingle vectors
    over pi; the cosine of sets of like size is 2 J / (1 + J), that of others more.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits * share + errors * math.sqrt(bits * share * (1 - share))


def link_fingerprints(
    nodes: DataFrame, count: int, threshold: int, parts: Sequence = GOLAY_PARTS, similarity: float | None = None,
    reach: int | None = None, errors: float = 1,
) -> DataFrame:
    """(id, component_id) of nodes (node, fps: `count` fingerprints each).

    Nodes link if, under one of the seeds, their fingerprints differ in at most
    `threshold` bits; with `similarity`, all their bits together must also
    speak for a Jaccard similarity of that much, within `errors` standard errors.
    With `reach`, all that meet at an anchor and differ in at most that many
    bits of its fingerprint link: within `threshold` all pairs meet, beyond it
    those that are as close as a part's share in any one part.

    Anchors are the words of a covering code in each part of a fingerprint.
    A fingerprint goes to every anchor within the code's covering radius plus
    the part's share of the threshold. The nearest anchor of one of two close
    words is then an anchor of both, so comparing the members at home there
    with all its members finds every link. Blocks give back stars of their
    local components, never pairs, and a crowded anchor is cut into blocks.
    """
    rounds = Rounds(nodes.sparkSession, "anchors")
    columns = ", ".join(f"f{k} long" for k in range(count))
    placed = nodes.mapInPandas(_place(threshold, parts), f"cell long, node long, home boolean, {columns}")
    placed = meet_in_blocks(placed.withColumn("mixed", F.xxhash64("node")), ["cell"], "mixed", rounds, BLOCK)
    most = 64 * count if similarity is None else most_bits(similarity, 64 * count, errors)
    # Small blocks share a task call; a crowded anchor's blocks are spread.
    bundle = F.when(F.col("parts") > 1, F.xxhash64("cell", "block")).otherwise(
        F.floor(F.col("cell") / (64 * max(1, BUNDLE // count))))
    edges = (
        placed.withColumn("bundle", bundle).drop("mixed", "parts").groupBy("bundle")
        .applyInPandas(_compare(threshold if reach is None else reach, count, most), "source long, target long")
    )
    return connected_components(nodes.select(F.col("node").alias("id")), rounds.cut(edges.distinct()))


def near_duplicates(
    docs: DataFrame, words: int = 4, threshold: int = THRESHOLD, seeds: Sequence[int] = (SEED,),
    parts: Sequence = GOLAY_PARTS, similarity: float | None = None,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of (doc_id, text).

    `component_id` is the smallest doc_id reachable over links, itself included;
    `fingerprint` is the one of the first seed. Null and blank texts have
    fingerprint zero and link like any other; copies meet by equality of
    fingerprints and are never compared. Repeated rows each get their row; other
    columns are ignored; a null doc_id gets its group's id.
    """
    small_batches(docs.sparkSession)
    rounds = Rounds(docs.sparkSession, "simhash")
    marked = rounds.cut(docs.select("doc_id", fingerprints(F.col("text"), words, seeds).alias("fps")))
    nodes = rounds.cut(
        marked.groupBy("fps").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    )
    groups = link_fingerprints(nodes.select("node", "fps"), len(seeds), threshold, parts, similarity)
    first = nodes.join(groups.withColumnRenamed("id", "node"), "node")
    lowest = first.groupBy("component_id").agg(F.min("least").alias("lowest"))
    ids = rounds.cut(first.join(lowest, "component_id").select("fps", F.col("lowest").alias("component_id")))
    return marked.join(ids, "fps").select(
        "doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: str | None, words: int, seed: int = SEED) -> tuple[bytes, np.ndarray]:
    """(digest, sorted hashes) of the distinct shingles of a text."""
    own = np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))
    return xxhash.xxh3_128_digest(own.tobytes()), own


def reseeded(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes as of the k-th of a family of functions, the 0th being themselves: SplitMix64's mixing of their sum with k steps."""
    if not k:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _sketches(text: Column, words: int) -> Column:
    """Digest of the shingle set and its fingerprints, each from another mixing of the same hashes."""

    @F.pandas_udf("digest binary, fps array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, prints, held, size = [], [], [], 0

            def settle() -> None:
                each = [majority((reseeded(own, k) for own in held), len(held)).view(np.int64) for k in range(STAGE_PRINTS)]
                prints.extend(np.stack(each, axis=1))
                held.clear()

            for t in batch:
                digest, own = shingle_set(t if isinstance(t, str) else None, words)
                digests.append(digest)
                held.append(own)
                size += len(own)
                if size >= BATCH_TOKENS:
                    settle()
                    size = 0
            if held:
                settle()
            yield pd.DataFrame({"digest": digests, "fps": prints})
        give_back()

    return run(text)


def _shingle_sets(text: Column, words: int) -> Column:
    """The shingle set itself, with its digest."""

    @F.pandas_udf("digest binary, hashes array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [shingle_set(t if isinstance(t, str) else None, words) for t in batch]
            yield pd.DataFrame({"digest": [d for d, _ in pairs], "hashes": [own.view(np.int64) for _, own in pairs]})
        give_back()

    return run(text)


def jaccard_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Smallest reachable index of each set, over links of exact Jaccard similarity `similarity` or more."""
    n = np.array([len(s) for s in sets])
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    each, owner = np.split(place, np.cumsum(n)[:-1]), np.repeat(np.arange(len(sets)), n)
    root, alone = np.arange(len(sets)), np.ones(len(sets), bool)
    for first in range(len(sets)):
        waiting = [first] if alone[first] else []
        alone[waiting] = False
        while waiting:
            at = waiting.pop()
            marked = np.zeros(len(names), bool)
            marked[each[at]] = True
            common = np.bincount(owner[marked[place]], minlength=len(sets))
            close = np.flatnonzero(alone & (common / np.maximum(n + n[at] - common, 1) >= similarity))
            root[close], alone[close] = first, False
            waiting += close.tolist()
            if len(close):
                left = alone[owner]
                place, owner = place[left], owner[left]
    return root


def _verify(similarity: float):
    def verify(members: pd.DataFrame) -> pd.DataFrame:
        """Exact links of a bundle of blocks as a star per local component."""
        members = members.sort_values(["component_id", "block", "node"], kind="stable")
        cell, block, nodes = (members[c].to_numpy() for c in ("component_id", "block", "node"))
        sets = [np.asarray(h, np.int64) for h in members["hashes"]]
        cuts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]), [True])))
        out = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            root = jaccard_roots(sets[lo:hi], similarity)
            off = np.flatnonzero(root != np.arange(hi - lo))
            out.append(np.stack([nodes[lo:hi][off], nodes[lo:hi][root[off]]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["source", "target"])

    return verify


def similar_groups(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, component_id) per row of (doc_id, text): groups linked by exact Jaccard similarity of shingle sets.

    SimHashes of the sets only choose candidates: rows that meet at an anchor and
    whose bits lie within STAGE_ERRORS standard errors of `similarity` or closer.
    Members of a group of candidates are then compared by their whole sets, known
    by 64-bit hashes, and only pairs of `similarity` or more link. Copies are one
    node from the start, as their sets have one digest. A large group of
    candidates is cut into blocks that meet two by two.
    """
    small_batches(docs.sparkSession)
    rounds = Rounds(docs.sparkSession, "similar")
    marked = rounds.cut(docs.select("doc_id", _sketches(F.col("text"), words).alias("of")).select("doc_id", "of.*"))
    nodes = rounds.cut(
        marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fps").alias("fps"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    near = link_fingerprints(
        nodes.select("node", "fps"), STAGE_PRINTS, STAGE_THRESHOLD, HAMMING_PARTS, similarity, STAGE_REACH, STAGE_ERRORS
    ).withColumnRenamed("id", "node")
    crowds = near.groupBy("component_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("component_id")
    members = rounds.cut(near.join(crowds, "component_id").join(nodes.drop("fps"), "node"))
    texts = docs.select("doc_id", "text")
    texts = texts.join(members.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").unionAll(
        texts.where(F.col("doc_id").isNull()))
    # other rows may share the doc_id that stands for a node, hence the join by digest
    sets, seen = rounds.measure(
        texts.select(_shingle_sets(F.col("text"), words).alias("of")).select("of.*").join(members, "digest")
        .groupBy("node", "component_id").agg(F.first("hashes").alias("hashes")), shingles=F.sum(F.size("hashes")),
    )
    placed = meet_in_blocks(
        sets.withColumn("mixed", F.xxhash64("node")), ["component_id"], "mixed", rounds, BLOCK_SHINGLES, F.size("hashes"))
    bundle = F.when(F.col("parts") > 1, F.xxhash64("component_id", "block")).otherwise(
        F.pmod(F.xxhash64("component_id"), F.lit((seen["shingles"] or 0) // BUNDLE_SHINGLES + 1)))
    edges = (
        placed.select("component_id", "block", "node", "hashes", bundle.alias("bundle")).groupBy("bundle")
        .applyInPandas(_verify(similarity), "source long, target long")
    )
    linked = connected_components(members.select(F.col("node").alias("id")), rounds.cut(edges.distinct()))
    first = nodes.select("node", "digest", "least").join(linked.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component_id", F.coalesce("component_id", "node"))
    lowest = first.groupBy("component_id").agg(F.min("least").alias("lowest"))
    ids = rounds.cut(first.join(lowest, "component_id").select("digest", F.col("lowest").alias("component_id")))
    return marked.join(ids, "digest").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; columns as they are.

    Groups are those of `similar_groups`. Rows without doc_id stay, as nothing
    can name them; of rows with one doc_id one stays.
    """
    found = similar_groups(docs, words, similarity)
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("copies"))
    named = docs.select("doc_id", F.struct("*").alias("row")).join(kept, "doc_id")
    single = named.where(F.col("copies") == 1).select("row.*")
    several = named.where(F.col("copies") > 1).groupBy("doc_id").agg(F.first("row").alias("row")).select("row.*")
    return single.unionAll(several).unionAll(docs.where(F.col("doc_id").isNull()))


STAGE_THRESHOLD = 7
STAGE_PRINTS = 4
STAGE_REACH = 20
STAGE_ERRORS = 4
BLOCK_SHINGLES = 500_000
BUNDLE_SHINGLES = 100_000


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
