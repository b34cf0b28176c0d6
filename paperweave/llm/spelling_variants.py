"""Operator 11: spelling variants by bitsets per position and letter."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import ASCII_LOWER, ASCII_UPPER, meet_in_blocks, small_batches, table
from paperweave.llm.merkle_manifest import CRC_TABLE, crc32_sql
from paperweave.session import Rounds

MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
BLOCK = 8_192
OUT_ROWS = 50_000
ONE_IN = 97
LETTERS = "A-Za-zÀ-ÿ"
BREAK = re.compile(f"[^{LETTERS}]")
PIECE_CHARS = 1_000_000
FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def misspelled(run: str, h: int) -> str:
    """The run, without one of its code points where ONE_IN divides the checksum."""
    return run if h % ONE_IN else run[:h % len(run)] + run[h % len(run) + 1:]


def pieces_of(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, none cut within a run of letters."""
    start = 0
    while len(text) - start > size:
        cut = BREAK.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def words_of(docs: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n): numbers of occurrences of the runs of letters, each task's added up per batch of texts.

    A-Z are lower-cased, runs of fewer than `min_letters` letters left out, and
    one in ONE_IN (by the crc32 of `<doc_id>:<run>`) lacks a letter, which may
    leave it shorter than that. Null and empty texts have none; a null doc_id is
    written as nothing. Repeated rows count each. Other columns are ignored.
    """
    run = re.compile(f"[{LETTERS}]{{{min_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                own: Counter[str] = Counter()
                for piece in pieces_of((text.as_py() or "").encode().lower().decode()):  # bytes: A-Z only
                    own.update(run.findall(piece))
                start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word, n in own.items():
                    words[misspelled(word, zlib.crc32(word.encode(), start))] += n
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least `min_letters` code points that occur at least `min_count` times."""
    return words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class PositionIndex:
    """Bit k of `at[p, c]` is set where the k-th word has letter c at position p; `long[m]` has the words of m letters.

    A bitset is one integer, so a step of a search works on all words at once.
    """

    def __init__(self, words: Sequence[str]):
        at: dict[tuple[int, str], list[int]] = defaultdict(list)
        long: dict[int, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            long[len(word)].append(k)
            for place in enumerate(word):
                at[place].append(k)
        self.every = (1 << len(words)) - 1
        width = (len(words) + 7) // 8
        self.at = {place: _bits(ks, width) for place, ks in at.items()}
        self.long = {m: _bits(ks, width) for m, ks in long.items()}

    def one_error(self, word: str) -> int:
        """The words that differ from `word` by exactly one inserted, deleted or replaced letter.

        `same` holds the words that agree with all letters so far; each of the
        three others those with one error so far, whose next letter stands at the
        same place, one place on or one place back.
        """
        at, m = self.at.get, len(word)
        same, replaced, longer, shorter = self.every, 0, 0, 0
        for i, letter in enumerate(word):
            here = at((i, letter), 0)
            longer = (longer | same) & at((i + 1, letter), 0)
            shorter = shorter & at((i - 1, letter), 0) | same
            replaced = replaced & here | same & ~here
            same &= here
            if not (same | replaced | longer | shorter):
                return 0
        long = self.long.get
        return replaced & long(m, 0) | (longer | same) & long(m + 1, 0) | shorter & long(m - 1, 0)


def _bits(places: list[int], width: int) -> int:
    held = bytearray(width)
    for k in places:
        held[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(held, "little")


def _set_bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _keyed(words: DataFrame) -> DataFrame:
    """Words with the keys of which two near words share one.

    Of two near words let the shorter have m letters, h = m div 2. The error
    lies behind the first h letters of both or before the last m - h of both, so
    one of these is equal. A word states both for itself as the shorter or equal
    one (m its length) and as the longer one (m a letter less).
    """
    m = F.col("m")
    halves = [F.struct(m.alias("base"), F.lit(side).alias("side")) for m in (m, m - 1) for side in ("head", "tail")]
    head = F.expr("base div 2")
    part = F.when(F.col("side") == "head", F.substring("word", F.lit(1), head)).otherwise(
        F.substring("word", m - (F.col("base") - head) + 1, F.col("base") - head))
    return words.withColumn("m", F.char_length("word")).withColumn("k", F.explode(F.array(*halves))).select(
        "word", "n", "m", "k.*").withColumn("part", part).drop("m").withColumn("spread", F.xxhash64("word"))


def _neighbours(base: int, side: str, block: int, parts: int, rows: list[tuple]) -> Iterator[tuple]:
    """(word, near, best_n, best) of the words of one block, rows of (word, n, half)."""
    index, alone = PositionIndex([w for w, _, _ in rows]), block // parts == block % parts
    width, head = (len(rows) + 7) // 8, base // 2
    half_of = {h: _bits([k for k, r in enumerate(rows) if r[2] == h], width) for h in {h for _, _, h in rows}}
    for word, _, half in rows:
        # a half by itself is asked for its own words, one that meets another only for those of the other
        found = index.one_error(word) & (index.every if alone else index.every ^ half_of[half])
        near, best = 0, None
        for k in _set_bits(found):
            other, n, _ = rows[k]
            if min(len(word), len(other)) != base or side == "tail" and word[:head] == other[:head]:
                continue  # they meet under another length, or under the equal first half too
            near += 1
            if best is None or (-n, other) < best:
                best = (-n, other)
        if near:
            yield word, near, -best[0], best[1]


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones, from distinct (word, n).

    Words meet under a shared half; the words of a half are one block, or blocks
    of parts of about `block` words that meet two by two. A block is indexed by
    position and letter and asked for each of its words; only a word's number of
    near words and the best of them leave it.
    """
    rounds = Rounds(words.sparkSession, "spelling")
    keyed = rounds.cut(_keyed(words))
    blocks = meet_in_blocks(keyed, ["base", "side", "part"], "spread", rounds, block)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in batch.schema.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (base, side, _, number, parts), group in groupby(rows_of(batches), itemgetter(0, 1, 2, 3, 4)):
            members = [r[5:] for r in group]
            if len(members) > 1:
                out += _neighbours(base, side, number, parts, members)
            if len(out) > OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)

    cell = ["base", "side", "part", "block"]
    found = blocks.select(*cell, "parts", "word", "n", "half").repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        search, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"),
    ).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def group_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their numbers of occurrences.

    Two words are near when one inserted, deleted or replaced code point makes
    them equal. A word's form is its near word of largest n, the smallest in
    code-point order on a tie, if that n is at least `ratio` times its own; its
    root follows forms to the last, itself if it has none. With a ratio above 1
    forms grow, so they never run in circles. No words give no rows; a null word
    has no near words. Words with equal n under a ratio of 2 have no form.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    rounds = Rounds(words.sparkSession, "variants")
    words = rounds.cut(words.select("word", "n"))
    near = near_words(words, block)
    has_form = F.col("best_n") >= F.col("n") * ratio
    rows, left = rounds.measure(words.join(near, "word", "left").select(
        "word", F.when(has_form, F.col("best")).alias("form"), F.coalesce(F.when(has_form, F.col("best")), "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best_n")).alias("form_n"),
    ), moved=F.count("form"))
    while left["moved"]:  # a root's root is twice as far along
        ahead = rows.where(F.col("root") != F.col("word")).select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, left = rounds.measure(rows.join(ahead, "root", "left").select(
            "word", "form", F.coalesce("next", "root").alias("root"), "n", "n_near", "form_n", F.col("next").isNotNull().alias("moved"),
        ), moved=F.count_if("moved"))
        rounds.drop(rows)
        rows = after.drop("moved")
    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(words_of(table(spark, sf_dir, "documents"))))


SQL = f"""WITH RECURSIVE {CRC_TABLE},
    runs AS MATERIALIZED (SELECT doc_id, translate(run, '{ASCII_UPPER}', '{ASCII_LOWER}') AS run, count(*) AS times
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
    hashed AS (SELECT run, times, {crc32_sql("doc_id::VARCHAR || ':' || run", 't')} AS h FROM runs, crc_table),
    words AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
        ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
    cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (SELECT DISTINCT * FROM (
      SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
      UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word)),
    best AS MATERIALIZED (SELECT word, arg_min(other, (-m, other)) AS other, max(m) AS m, count(*) AS n_near FROM near GROUP BY 1),
    forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * words.n THEN other END AS form,
        CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
    walk(word, root, step) AS (SELECT word, word, 0 FROM forms
      UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY 1)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
