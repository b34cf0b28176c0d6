"""Spelling variants, Merkle manifest and token files against plain versions, with their edge cases."""

import glob
import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from paperweave.llm import merkle_manifest, spelling_variants, token_files
from paperweave.llm.common import fold_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# spelling variants

def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(count, ratio=2):
    near = {w: [v for v in count if one_error(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def variants(spark, count, **options):
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.group_variants(words, **options).collect()}


@pytest.mark.parametrize("block", [8_192, 7])
def test_variants_of_all_lengths(spark, block):
    """Words of 0 to 9 letters over a small alphabet: every kind of error, ties, long chains and crowded halves."""
    rng = random.Random(block)
    count = {"".join(rng.choice("aÿé") for _ in range(rng.randrange(8))): rng.choice([3, 4, 8, 20, 50, 400]) for _ in range(700)}
    want = plain_variants(count)
    assert {w for w in want if want[w][3] > 12} and any(want[w][1] not in (w, want[w][0]) for w in want)
    assert variants(spark, count, block=block) == want


def test_long_chain_and_nothing(spark):
    chain = {"a" * k + "b" * (20 - k): 3 * 2**k for k in range(21)}
    assert {r for _, r, *_ in variants(spark, chain).values()} == {"a" * 20}
    assert variants(spark, {}) == {}
    with pytest.raises(ValueError):
        variants(spark, {}, ratio=1)


def test_position_index():
    words = ["abc", "abd", "ab", "bc", "abcd", "xabc", "axc", "abc" * 50]
    found = spelling_variants.PositionIndex(words).one_error("abc")
    assert {words[k] for k in spelling_variants._set_bits(found)} == {w for w in words if one_error("abc", w)}


def test_words_of_texts(spark):
    texts = {1: "Haus haus HÄUSER, x" * 3 + "÷mal×mal", 2: None, 3: "", None: "haus haus", 5: "wort1wortwort " * 200_000}
    rows = [(i, t, "c", 0) for i, t in texts.items()] + [(1, texts[1], "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    want = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    got = {r.word: r.n for r in spelling_variants.vocabulary(spelling_variants.words_of(docs), 5, 1).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5}


def test_pieces_are_the_text():
    text = "ab " * 10 + "c" * 50 + " d"
    pieces = list(spelling_variants.pieces_of(text, 7))
    assert "".join(pieces) == text and "c" * 50 in "".join(p for p in pieces if "c" in p) and len(pieces) > 3
    assert sum(len(re.findall("[a-z]+", p)) for p in pieces) == 12


# Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def plain_path(levels, at, fanout):
    path = []
    for level in levels[:-1]:
        first = at - at % fanout
        path.append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
        at //= fanout
    return path


def plain_manifest(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = own, plain_levels([plain_leaf(*r) for r in own], fanout)
    crown = plain_levels([trees[lang][1][-1][0] for lang in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, row in enumerate(own):
            path = plain_path(levels, at, fanout) + plain_path(crown, k, fanout)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = plain_leaf(*row[:4], row[4] + 1) if tampered and row[4] is not None else plain_leaf(*row)
            for before, after in path:
                node = h(before, node, after)
            out.append((row[0], plain_leaf(*row), levels[-1][0], crown[-1][0], h(*[b + a for b, a in path]), node, node == crown[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "place": F.lit(1), "tree": F.lit("y")})
    out = merkle_manifest.manifest(docs, fold_of(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1, **options)
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize(("fanout", "slots"), [(2, 8), (3, 9), (4, 4)])
def test_manifest(spark, fanout, slots):
    """Langs of 1 to 150 rows, null and empty ones, null ids and counts, repeated ids and rows."""
    rows = [(i, f"text é {i}", "en", None if i % 5 else "s", None if i % 4 == 0 else i) for i in range(150)]
    rows += [(i, None, "de", "s", 7) for i in range(17)] + [(7, "", "", "", 0), (None, "x", None, None, 1), (9, "x", None, None, 1)]
    rows += [(3, "again", "en", "s", 1)] * 3 + [(None, "x" * 100_000, "fr", "s", 2)]
    got = manifest(spark, rows, fanout=fanout, slots=slots)
    assert got == plain_manifest(rows, fanout)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_small_manifests(spark):
    assert manifest(spark, []) == []
    one = manifest(spark, [(1, "a", "en", "s", 1)])
    assert one == plain_manifest([(1, "a", "en", "s", 1)], 2) and one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")


# token files

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


def test_pieces_are_encoded_as_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = ["a", "B", "é", " ", " ", "\n", "  ", "\t", ",", "'s", "'", "1", "23", "<|endoftext|>", "　", "中", " ", ".", "!?",
             "x y", "\n\n", "\x1c", "🙂", "×", "ª", "foo", "Bar", "\r\n", "_", " ", "​", "foo, bar"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(5_000)] + ["", None, " ", "\n", "a\nb"]
    encoder = token_files.PieceEncoder(public_tokenizers.path(token_files.TOKENIZER))
    for _ in range(2):
        got = [ids.tolist() for ids in encoder.encode(pa.array(texts))]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_of_pieces_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 50)
    encoder = token_files.PieceEncoder(public_tokenizers.path(token_files.TOKENIZER))
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(30))
        assert next(encoder.encode(pa.array([text]))).tolist() == tokenizer.encode(text).ids
        assert len(encoder.number) <= 100


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_files.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))


def plain_tokens(rows, tokenizer):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tokenizer, encoding):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Some", "words,", "of", "text."]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(None, "no id"), (400, None), (401, ""), (402, "long " * 100_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "part": F.lit("p"), "start": F.lit(0)})
    with tempfile.TemporaryDirectory() as path:
        token_files.write_tokens(docs, path, encoding=encoding, row_group_bytes=1 << 18, page_bytes=1 << 14)
        want = plain_tokens(rows, tokenizer)
        got = token_files.read_tokens(spark, path)
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
        checked = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.with_crc32(got).collect()}
        assert checked == {(i, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, n, ids in want}

        lengths = token_files.read_lengths(spark, path)
        assert "ids" not in lengths._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in lengths.collect()} == {w[:3] for w in want}

        every = [x for *_, ids in want for x in ids]
        for start, length in ((0, 1), (777, 1234), (len(every) - 5, 50), (len(every), 3), (10, 0)):
            span = sorted(token_files.read_span(spark, path, start, length).collect(), key=lambda r: r.start)
            assert [x for r in span for x in r.ids] == every[start:start + length]

        columns = Counter()
        for name in glob.glob(f"{path}/tokens/*.parquet"):
            meta = pq.ParquetFile(name).metadata
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    column = meta.row_group(g).column(c)
                    assert column.has_offset_index and column.has_column_index or column.path_in_schema.startswith("ids")
                    columns[column.path_in_schema, *sorted(column.encodings)] += 1
        kinds = {name: set(found) for name, *found in columns}
        assert "DELTA_BINARY_PACKED" in kinds["doc_id"] & kinds["local"]
        assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in kinds["ids.list.element"]


def test_empty_set_and_repeated_rows(spark, tokenizer):
    with tempfile.TemporaryDirectory() as path:
        token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
        assert token_files.read_tokens(spark, path).count() == 0 and token_files.read_span(spark, path, 0, 10).count() == 0
        docs = spark.createDataFrame([(7, "same text")] * 1_000 + [(3, "other")], "doc_id long, text string")
        token_files.write_tokens(docs, path)
        assert sorted(tuple(r) for r in token_files.read_tokens(spark, path).collect()) == plain_tokens([(7, "same text")] * 1_000 + [(3, "other")], tokenizer)
        with pytest.raises(ValueError):
            token_files.write_tokens(docs, path, encoding="plain")


def test_query(spark, tokenizer):
    rows = spark.read.parquet(f"{oracle.ROOT}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {(i, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, n, ids in plain_tokens([tuple(r) for r in rows], tokenizer)}
    got = token_files.query(spark, f"{oracle.ROOT}/sf0.01").collect()
    assert len(got) == len(rows) and {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got} == want
