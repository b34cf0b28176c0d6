"""Operator 13: token ids in Parquet list columns, read back by document or by token range."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from paperweave.llm.common import small_batches, table
from paperweave.session import checkpoint_root

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
PIECES = 400_000
BYTES_AT_ONCE = 4_000_000
PIECES_AT_ONCE = 20_000
WHITE = ("Ġ", "Ċ")
LARGE = pa.large_string()
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(f"[ \n][{LETTERS}]+")
PLAIN = "^(?P<head>\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,!?;:]{1,3})$"
ODD = "^$|^[ \n]|  | \n|\n |\n\n|[ \n]$|[\\t\\x0b\\f\\r\\x1c-\\x1f]|[\\x{0085}\\x{00a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{200b}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
LIST = pa.list_(pa.field("element", pa.int32()))
CODED = pa.schema([("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids", LIST)])
TOKENS = "doc_id long, local long, n_tokens long, ids array<int>"


class PieceEncoder:
    """Ids of whole texts from a byte-level tokenizer that parts them before blanks, as the usual pattern does.

    A blank or line feed between two other characters always begins a piece, so
    a text's ids are those of its pieces in order, and those of a piece of letters
    and marks are its letters' and its marks'. Each run of letters is encoded
    once, a blank and letters by the tokenizer's model as the one piece that they
    are to it, and kept, in bounded memory. Texts that hold other or
    repeated white space, and those that hold a special token, are encoded as a
    whole. A tokenizer of another kind is refused.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        parts = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer or not isinstance(parts, ByteLevel) or parts.add_prefix_space or not parts.use_regex:
            raise ValueError(f"{path}: not a byte-level tokenizer without normalization")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(WHITE)]] = True
        bare = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: bare.pre_tokenize_str(chr(i))[0][0] for i in range(256) if WORD.fullmatch(f" {chr(i)}") or i == 32}
        self.shown[10] = ""  # a line feed before letters is a piece of its own
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _forget(self, but: list[str]) -> None:
        """Keep only these pieces. Piece 0 is nothing; piece k has the ids from `at[k]`, `size[k]` of them."""
        kept = [p for p in but if p in self.number and p]
        own = np.fromiter(map(self.number.__getitem__, kept), np.int64, len(kept))
        size = self.size[own]
        ids = self.flat[np.repeat(self.at[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self._clear()
        self._keep(kept, [ids], size)

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[str], ids: list[np.ndarray], size: np.ndarray) -> None:
        """Number the pieces; `ids` are theirs one after the other, `size` how many each has."""
        self.number.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *ids])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, new ones encoded many in one call and parted where a token begins with white space."""
        found = list(map(self.number.get, pieces))
        new = [p for p, k in zip(pieces, found) if k is None]
        words = [p for p in new if WORD.fullmatch(p)]
        if words:
            model = self.tokenizer.model
            ids = [[*(self.feed if p[0] == "\n" else ()), *(t.id for t in model.tokenize(p.translate(self.shown)))] for p in words]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(words, [np.fromiter(chain.from_iterable(ids), np.uint32, size.sum())], size)
        rest = [p for p in new if p not in self.number] if len(words) < len(new) else []
        for lo in range(0, len(rest), PIECES_AT_ONCE):
            part = rest[lo:lo + PIECES_AT_ONCE]
            ids = self.whole(["".join(part)])
            cuts = np.flatnonzero(self.opens[ids[0]])
            if len(cuts) == len(part):
                self._keep(part, ids, np.diff(np.append(cuts, len(ids[0]))))
            else:  # marks, which begin with themselves
                ids = self.whole(part)
                self._keep(part, ids, np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.fromiter((self.number[p] if k is None else k for p, k in zip(pieces, found)), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null is empty."""
        total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + BYTES_AT_ONCE, side="right")))
            yield from self._encode(texts.slice(start, end - start))
            start = end

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Texts are parted and their distinct pieces numbered by Arrow, and the ids put together by array indexing."""
        texts = pc.fill_null(texts, "").cast(LARGE)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        for special in self.special:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        # a piece is what begins with a blank or, behind a line feed, with that; the first one begins as if behind one
        plain = pc.replace_substring(pc.if_else(pa.array(odd), pa.scalar("", LARGE), texts), "\n", " \n")
        parted = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(" \n", LARGE), plain, pa.scalar("", LARGE)), " ")
        coded = parted.flatten().dictionary_encode()
        found = pc.extract_regex(coded.dictionary, PLAIN)
        heads = pc.coalesce(pc.struct_field(found, "head"), coded.dictionary).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(found, "mark"), "").dictionary_encode()
        begun, lined = pc.starts_with(heads.dictionary, "\n"), pc.binary_join_element_wise(pa.scalar("", LARGE), heads.dictionary, pa.scalar(" ", LARGE))
        names = pc.if_else(begun, heads.dictionary, lined).to_numpy(zero_copy_only=False).tolist()
        names = [p if len(p) > 1 else "" for p in names]  # a line feed or blank alone is the next piece's
        if len(self.number) + len(names) > PIECES:
            self._forget(names)
        number = self.numbers(names)[heads.indices.to_numpy()], self.numbers(marks.dictionary.to_pylist())[marks.indices.to_numpy()]
        pairs = np.stack(number, axis=1)[coded.indices.to_numpy()].ravel()  # letters and marks of each piece in turn
        size = self.size[pairs]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.at[pairs] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[2 * (parted.offsets.to_numpy() - parted.offsets[0].as_py())]
        for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            yield self.whole([texts[k].as_py()])[0] if odd[k] else ids[lo + 1:hi]  # the first id is the line feed put there


@lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """One while a Python worker lives, so its next tasks know the commonest pieces already."""
    return PieceEncoder(path)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, local, n_tokens, ids) in order of doc_id over all partitions; `local` counts the ids before, within a partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, local = encoder_of(tokenizer), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, starts, ids = batch.column("doc_id"), [local], []
            for k, own in enumerate(encoder.encode(batch.column("text"))):
                ids += (own, end)
                starts.append(starts[-1] + len(own) + 1)
                if 4 * (starts[-1] - starts[0]) >= BYTES_AT_ONCE or k + 1 == len(rows):
                    n = np.diff(starts)
                    column = pa.ListArray.from_arrays(
                        np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [rows.slice(k + 1 - len(n), len(n)), pa.array(np.array(starts[:-1])), pa.array(n), column.cast(LIST)],
                        schema=CODED)
                    starts, ids = starts[-1:], []
            local = starts[-1]
            pa.default_memory_pool().release_unused()  # the worker lives on, beside others

    small_batches(docs.sparkSession)
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return ordered.drop("row").mapInArrow(encode, TOKENS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary",
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write the ids of every text, each followed by `end_id`, as Parquet files in ascending order of doc_id.

    `path`/tokens has a row per document: doc_id, part (the number of the range
    it is in), local (ids before it in that part), n_tokens and the list `ids`.
    `encoding` "dictionary" stores ids as bit-packed places in a dictionary,
    "delta" as bit-packed differences; the other columns are differences. Row
    groups hold about `row_group_bytes` of stored values and are read one at a
    time, pages about `page_bytes`, and page indexes name each page's least and
    greatest doc_id, so that readers of some documents skip the other pages, and
    readers of lengths never touch ids. `path`/parts has a row per part with its
    doc_ids and the ids before it; it is written last, so a writing that fails
    leaves no readable set.

    Null text is empty and gives `end_id` alone. A null doc_id comes first;
    repeated ids stand side by side, in the order they are read. An empty
    table gives an empty set. Other columns are ignored. Ranges have about
    equal numbers of documents, as many as the session has shuffle partitions.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": 1 << 20,
    }
    rows = encoded(docs, tokenizer or public_tokenizers.path(TOKENIZER), end_id)
    rows.select("doc_id", F.spark_partition_id().alias("part"), "local", "n_tokens", "ids").write.options(
        **{k: str(v) for k, v in options.items()}).mode("overwrite").parquet(f"{path}/tokens")
    spark = docs.sparkSession
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("docs"),
        F.sum("n_tokens").alias("part_tokens"))
    # a row per range, so one task orders as many rows as there were tasks
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("part_tokens").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{path}/parts")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document, without reading any ids."""
    return read_tokens(spark, path).drop("ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); filters on doc_id reach the files' pages, `start` counts the ids of all documents before."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    return spark.read.parquet(f"{path}/tokens").join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(doc_id, start, ids): the documents' shares of the ids from `start` on, as the whole set were one sequence.

    The part table settles which places of which parts are asked, and those
    conditions reach the scan, so only their pages are read.
    """
    end = start + length
    asked = spark.read.parquet(f"{path}/parts").where((F.col("base") < end) & (F.col("base") + F.col("part_tokens") > start))
    found = spark.read.parquet(f"{path}/tokens")
    near = [  # a row per part that the span touches
        (F.col("part") == p.part) & (F.col("local") < end - p.base) & (F.col("local") + F.col("n_tokens") > start - p.base)
        for p in asked.select("part", "base").collect()
    ]
    hits = found.where(_any(near)).join(asked.select("part", "base"), "part").withColumn("at", F.col("base") + F.col("local"))
    low = F.greatest(F.lit(start) - F.col("at"), F.lit(0))
    high = F.least(F.lit(end) - F.col("at"), F.col("n_tokens"))
    return hits.select("doc_id", (F.col("at") + low).alias("start"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def with_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): checksums of the ids as little-endian unsigned 32-bit integers."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])
            pa.default_memory_pool().release_unused()

    small_batches(tokens.sparkSession)
    return tokens.select("doc_id", "start", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return with_crc32(read_tokens(spark, path))
