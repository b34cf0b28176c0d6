"""Operator 4: best-fit packing of token sequences improved by swap-based local search."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperweave.llm.common import give_back, small_batches, table
from paperweave.session import Rounds

CAPACITY = 4096
END_ID = 1
CHUNK_PIECES = 20_000
FULL = 0.995
WORD_CACHE = 400_000
BYTES_AT_ONCE = 4_000_000
WORDS_AT_ONCE = 8_000
WORD_END = "</w>"
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|%$#&*]{0,3})")
BINS_PER_CHUNK = 1 << 24
PIECE_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("no_id", pa.bool_()), ("piece", pa.int32()), ("start", pa.int64()),
    ("length", pa.int64()), ("ids_crc32", pa.int64()),
])
PIECES = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of whole texts from a tokenizer that lower-cases, parts words at blanks and marks their ends.

    Such a text's ids are its words' ids in order, so words are encoded once and
    kept, in bounded memory. A plain word with marks behind it is its letters'
    ids and its marks' ids; the letters of many new words are encoded in one
    call and parted where a token ends a word. All other words are encoded as
    they are, and texts with a special token as a whole, since those are matched
    before words are cut.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learned(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new plain words, many in one call."""
        out = {}
        for lo in range(0, len(new), WORDS_AT_ONCE):
            part = new[lo:lo + WORDS_AT_ONCE]
            ids = self._bytes([" ".join(part)])[0]
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                out.update(zip(part, map(ids.__getitem__, map(slice, [0, *cuts], cuts))))
            else:
                out.update(zip(part, self._bytes(part)))
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        letters, marks, odd = [], [], []
        for word in words:
            m = PLAIN_WORD.fullmatch(word)
            if m:
                letters.append(m[1].lower())
                marks.append(m[2])
            else:
                letters.append(None)
                marks.append("")
                odd.append(word)
        known = self.letters
        new = {c for c in letters if c is not None and c not in known}
        if new:
            fresh = self._learned(list(new))
            if len(known) + len(fresh) > WORD_CACHE:
                self.letters = fresh if len(fresh) <= WORD_CACHE else {}
                known = {c: known[c] for c in letters if c in known} | fresh
            else:
                known.update(fresh)
        for mark in set(marks) - self.marks.keys():
            self.marks[mark] = self._bytes([mark])[0]
        others = (ids for lo in range(0, len(odd), WORDS_AT_ONCE) for ids in self._bytes(odd[lo:lo + WORDS_AT_ONCE]))
        return [next(others) if c is None else known[c] + self.marks[m] for c, m in zip(letters, marks)]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + BYTES_AT_ONCE, side="right")))
            yield from self._encode(texts.slice(start, end - start))
            start = end

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts are parted and their distinct words numbered by Arrow, and the ids put together by array indexing."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        parted = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parted.flatten().dictionary_encode()
        ids = self.words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        at = np.cumsum(size) - size
        number = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size[number])))
        offsets = parted.offsets.to_numpy() - parted.offsets[0].as_py()
        for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
            if whole[k]:
                yield self._bytes([texts[k].as_py()])[0]
                continue
            own = number[lo:hi]
            first = np.repeat(at[own] - (ends[lo:hi] - ends[lo]), size[own])
            yield flat[first + np.arange(len(first))].tobytes()


def tokenized_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, no_id, piece, start, length, ids_crc32): each document's ids and END_ID, cut at CAPACITY.

    Null text is empty and gives END_ID alone; nothing else is added or lost.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)  # its memory of words ends with the task
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), CAPACITY * 4)):
                    part = ids[at:at + CAPACITY * 4]
                    rows.append((doc_id or 0, doc_id is None, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_pydict(dict(zip(PIECE_SCHEMA.names, zip(*rows) if rows else [()] * 6)), PIECE_SCHEMA)
            pa.default_memory_pool().release_unused()  # the worker lives on, beside others
        del encoder
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size: largest first, each into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-sizes, kind="stable"):
        need = int(sizes[i])
        at = bisect_left(rooms, (need, -1))
        if at < len(rooms):
            room, where = rooms.pop(at)
        else:
            room, where, n = capacity, n, n + 1
        bins[i] = where
        if room > need:
            insort(rooms, (room - need, where))
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties underfull bins by exchanges that raise the sum of squared fills.

    From the emptiest bin upwards, each of its documents is moved into a fuller
    bin that has room, or exchanged for one or for two smaller documents of a
    fuller bin, taking the exchange that moves the most. Any such step takes
    load from a bin to a fuller one, so the sum of squares rises and the search
    ends; a bin that loses its last document is gone.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    settled = np.zeros(len(fill), bool)
    while True:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity) & ~settled)
        if len(open_bins) < 2:
            return bins
        source = int(open_bins[np.argmin(fill[open_bins])])
        moved = True
        while moved and fill[source]:
            moved = _step(sizes, bins, fill, source, capacity)
        settled[source] = True


def _step(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, source: int, capacity: int) -> bool:
    """The best single exchange that takes load out of `source`; False if there is none."""
    own = np.flatnonzero(bins == source)
    room = capacity - fill
    usable = (fill >= fill[source]) & (room > 0)
    usable[source] = False
    if not usable.any():
        return False
    targets = np.flatnonzero(usable)
    targets = targets[np.argsort(room[targets], kind="stable")]
    rooms = room[targets]
    for i in own[np.argsort(-sizes[own], kind="stable")]:
        at = int(np.searchsorted(rooms, sizes[i]))
        if at < len(targets):
            return _apply(sizes, bins, fill, [i], [], source, int(targets[at]))
    others = np.flatnonzero(usable[bins])
    gain, best = 0, None
    for i in own:
        delta = sizes[i] - sizes[others]
        delta = np.where((delta > 0) & (delta <= room[bins[others]]), delta, 0)
        k = int(delta.argmax()) if len(delta) else 0
        if len(delta) and delta[k] > gain:
            gain, best = int(delta[k]), ([i], [others[k]], int(bins[others[k]]))
    order = others[np.lexsort((sizes[others], bins[others]))]
    pair = np.flatnonzero(bins[order[1:]] == bins[order[:-1]])
    a, b = order[pair], order[pair + 1]
    for i in own:
        delta = sizes[i] - sizes[a] - sizes[b]
        delta = np.where((delta > gain) & (delta <= room[bins[a]]), delta, 0)
        if len(delta) and (k := int(delta.argmax())) >= 0 and delta[k] > gain:
            gain, best = int(delta[k]), ([i], [a[k], b[k]], int(bins[a[k]]))
    if best is None:
        return False
    return _apply(sizes, bins, fill, *best[:2], source, best[2])


def _apply(sizes, bins, fill, out: list, back: list, source: int, target: int) -> bool:
    bins[out], bins[back] = target, source
    load = int(sizes[out].sum() - (sizes[back].sum() if len(back) else 0))
    fill[source] -= load
    fill[target] += load
    return True


def _pack_chunk(capacity: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable")
        sizes = pieces["length"].to_numpy(np.int64)
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        _, bins = np.unique(bins, return_inverse=True)
        order = np.argsort(bins, kind="stable")
        sizes, bins = sizes[order], bins[order]
        total = np.cumsum(sizes) - sizes
        first = np.concatenate(([True], bins[1:] != bins[:-1])) if len(bins) else np.zeros(0, bool)
        out = pieces.iloc[order].copy()
        out["sequence_id"] = out.pop("chunk").to_numpy(np.int64) * BINS_PER_CHUNK + bins
        out["offset"] = total - np.repeat(total[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        out["fill"] = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return out

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_chunk: int = CHUNK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (PIECES) of 1 to `capacity` tokens; `no_id` becomes a null doc_id.

    Full pieces are sequences of their own. The others are dealt by hash into
    chunks of about `per_chunk`, packed by best fit and local search. Sequences
    less than FULL full come back for a second round in which the leftovers of
    many chunks share one, so the waste does not grow with the number of chunks.
    """
    rounds = Rounds(pieces.sparkSession, "packing")
    pieces, seen = rounds.measure(pieces, n=F.count("*"))
    schema = f"{PIECES}, sequence_id long, offset long, fill long"
    spread = F.xxhash64("doc_id", "piece", "start", "ids_crc32")

    def one_round(rows: DataFrame, n: int, base: int) -> DataFrame:
        chunks = max(1, -(-n // per_chunk))
        dealt = rows.withColumn("chunk", F.pmod(spread, F.lit(chunks)) + F.lit(base))
        return dealt.groupBy("chunk").applyInPandas(_pack_chunk(capacity), schema)

    packed = rounds.cut(one_round(pieces, seen["n"], 0))
    loose = packed.where(F.col("fill") < FULL * capacity).select(pieces.columns)
    loose_n = loose.count()
    again = one_round(loose, loose_n, -(-seen["n"] // per_chunk) + 1)
    return packed.where(F.col("fill") >= FULL * capacity).unionByName(again).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32",
        "sequence_id", "offset",
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place; other columns are ignored, repeated rows are packed each."""
    return pack(tokenized_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
