"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperweave.llm import (
    anchor_simhash,
    chat_windows,
    cross_parse,
    deleted_lm,
    line_spread,
    pivot_index,
    string_tiling,
    swap_packing,
    url_rules,
    warc_index,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 131}" for i in range(60_000))
BIG = (1 << 60) + 1  # not a double


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case and extra columns named as inner ones."""
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door", "en", "a", 50),
        (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n ", "en", "b", 4),
        (5, LONG, "en", "c", len(LONG)), (6, LONG, "en", None, len(LONG)),
        (7, "der Hund und die Katze liegen vor der Tuer im Haus", "de", "b", 50),
        (7, "der Hund und die Katze liegen vor der Tuer im Haus", "de", "b", 50),
        (None, "a row without an id of its own", "en", "a", 30), (BIG, "12 34 %% ..", None, "d", 11),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for clash in ("row", "key", "gone", "kept", "node", "fps", "copies", "site", "n_removed", "said", "kind", "seed", "no_id", "score"):
        docs = docs.withColumn(clash, F.lit("x"))
    return docs


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_lines(spark, odd, empty):
    out = line_spread.remove_boilerplate(odd, min_sites=2).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    assert by[2].text is None and by[2].n_lines == 0
    assert by[5].text == LONG and by[6].text == "" and by[6].n_removed == 1  # the first keeps the line
    assert by[4].text == " \t\n " and by[None].n_removed == 0
    assert by[1].key == "x"
    kept = line_spread.clean(odd, min_sites=2)
    assert kept.columns == odd.columns and {r.n_removed for r in kept.collect()} == {"x"}
    assert line_spread.clean(empty).collect() == []


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(i, f"own {i}\nnine\nten" if i < 9 else f"own {i}\nten", None, f"s{i}", 0) for i in range(10)]
    rows += [(100 + i, "many from one site", None, "s0", 0) for i in range(50)]
    out = {r.doc_id: r.text for r in line_spread.clean(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0] == "own 0\nnine\nten" and out[1] == "own 1\nnine" and out[9] == "own 9"
    assert out[149] == "many from one site"


def test_urls(spark):
    schema = "page_id long, url string, html string, host string, rule string"
    urls = [
        None, "", "no scheme", "http://Example.ORG/es/1", "http://a.example.org/en/12", "http://a.example.org/en/2",
        "http://x.com/fr/", "http://x.com/de/?q", "http://com", "https://notexample.org#f", "http://example.org",
        "http://a.b.c.d.example.org/es/" + "p" * 10_000,
    ]
    pages = spark.createDataFrame([(i, u, None, "h", "r") for i, u in enumerate(urls)] * 2, schema)
    rules = url_rules.rule_table(spark, url_rules.RULES)
    out = url_rules.judge_urls(pages, rules)
    assert out.count() == 2 * len(urls)
    by = {r.page_id: (r.host, r.rule, r.verdict) for r in out.collect()}
    assert by[0] == by[1] == by[2] == ("", None, "allow")
    assert by[3] == ("example.org", "example.org/es/", "block")
    assert by[4][1:] == ("example.org/en/1", "block") and by[5][1:] == ("org/", "allow")
    assert by[6][1:] == ("com/fr/", "allow") and by[7][1:] == ("com/de/", "block")
    assert by[8][1:] == (None, "allow") and by[9] == ("notexample.org", None, "allow") and by[10][1] is None
    assert by[11][1] == "example.org/es/"
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    none = spark.createDataFrame([], "rule_host string, rule_path string, verdict string")
    assert {r.verdict for r in url_rules.judge_urls(pages, none, "block").collect()} == {"block"}


def test_rule_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.org/bc")], "page_id long, url string")
    rules = url_rules.rule_table(spark, [("org", "/bc", "allow"), ("a.org", "/", "block"), ("a.org", "/", "allow")])
    assert url_rules.judge_urls(pages, rules).first()[3:] == ("a.org/", "block")


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, block string, tokens string"
    text = "</s>[INST] \\ <|x|> ok [/INST]"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", text), (1, 2, "assistant", text), (1, 2, "assistant", None),
            (2, 0, "assistant", "w " * 9_000), (2, 1, None, "end"), (None, None, "user", "nobody"), (3, 5, "a|b\\", "")]
    rows += [(4, 0, "system", "rules")] + [(4, i, ("user", "assistant")[i % 2], f"t {i} " * 90) for i in range(1, 700)]
    turns = spark.createDataFrame([(*r, "b", "t") for r in rows], schema)
    windows = chat_windows.chat_windows(turns)
    by = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    assert set(by) == {1, 2, 3, 4, None}

    def digest(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    for conv in by:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert by[conv].n_turns == len(own)
        assert by[conv].turns_sha256 == digest(f"{role}\n{t}\n" for _, role, t in own)
        assert by[conv].loss_sha256 == digest(t for _, role, t in own if role == "assistant")
        assert by[conv].loss_chars == sum(len(t) for _, role, t in own if role == "assistant")
    held = windows.where("conv_id = 4").collect()
    assert len(held) > 10 and {r.block for r in held} == {0, 1, 2}
    assert all(r.text.startswith("<|system|>rules</s>") for r in held)
    assert all(r.repeated >= 1 for r in held if (r.block, r.window) != (0, 0))
    size = [len(r.text.split()) for r in held]
    assert max(size) <= chat_windows.BUDGET
    assert chat_windows.read_back(chat_windows.chat_windows(turns.limit(0))).count() == 0


def test_packing(spark, odd, empty):
    out = swap_packing.pack_documents(odd).collect()
    assert len({(r.doc_id, r.piece) for r in out}) == len(out) - 1  # one row twice
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, 7, BIG, None}
    assert [(r.length, r.ids_crc32) for r in out if r.doc_id == 2] == [(1, zlib.crc32(np.array([1], "<u4").tobytes()))]
    placed = {}
    for r in out:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert swap_packing.pack_documents(empty).collect() == []


def test_tokenizer_parts_equal_the_whole(monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = swap_packing.WordEncoder(path)
    texts = ["", " ", "It's  I'll\n\nTHE 12,5%\x1c  x", "a<|endoftext|>b", "é ́ ﬁ İ ẞ ΣΑΣ", "x" * 5_000, "日本語 🙂\r\n\t end"]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(pa.array(texts))]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == want
    for cache, at_once in ((0, 1), (3, 40), (5, 10**9)):  # memory smaller than a batch's words
        monkeypatch.setattr(swap_packing, "WORD_CACHE", cache)
        monkeypatch.setattr(swap_packing, "BYTES_AT_ONCE", at_once)
        small = swap_packing.WordEncoder(path)
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(pa.array(texts))] == want
    assert list(encoder.encode(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("seed", range(4))
def test_local_search(seed):
    sizes = np.random.default_rng(seed).integers(1, 101, 80)
    start = np.arange(80)  # every document alone
    bins = swap_packing.local_search(sizes, start, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100 and fill.sum() == sizes.sum()
    before = np.bincount(start, weights=sizes)
    assert (fill ** 2).sum() >= (before ** 2).sum()
    assert (fill > 0).sum() <= sizes.sum() / 100 * 1.1 + 2
    best = swap_packing.best_fit(sizes, 100)
    assert np.bincount(best, weights=sizes).max() <= 100


@pytest.mark.parametrize("sizes, start", [
    ([7, 2, 8, 3], [0, 0, 1, 2]),  # 3 for 2, then 2 moves
    ([7, 1, 1, 8, 3], [0, 0, 0, 1, 2]),  # 3 for two ones, then both move
])
def test_exchanges_empty_a_bin(sizes, start):
    bins = swap_packing.local_search(np.array(sizes), np.array(start), 10)
    assert len(set(bins)) == 2


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, i % 3, (base[i] * 3 + rng.normal(size=16) * 0.02).tolist()) for i in range(20)]
    rows += [(200, None, base[0].tolist()), (201, 0, None), (202, 0, [0.0] * 16), (203, 0, [1.0, None] + [0.0] * 14),
             (204, 0, [float("nan")] * 16), (205, 0, [float("inf")] * 16), (206, 0, []), (207, 0, [1.0, 2.0]),
             (208, 0, base[0].tolist()), (208, 0, base[0].tolist()), (209, 0, (base[0] * 1e300).tolist())]
    out = pivot_index.near_vectors(
        spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, key string, node string")
    ).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out}
    for i in (200, 201, 202, 203, 204, 205, 206, 207):
        assert by[i][1:] == (0, i, True)
    assert all(by[100 + i].component_id == i and not by[100 + i].kept for i in range(20))
    assert by[0].n_links == 4 and by[208].n_links == 4 and by[209].n_links == 4  # 100, 208 twice, 209
    assert by[39].n_links == 0
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert pivot_index.near_vectors(none).collect() == []


def test_crowded_lists_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    center = rng.normal(size=16)
    rows = [(i, 0, (center + rng.normal(size=16) * 0.25).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = sorted(pivot_index.near_vectors(frame).collect())
    monkeypatch.setattr(pivot_index, "BLOCK", 40)
    assert sorted(pivot_index.near_vectors(frame).collect()) == want
    unit = np.array([r[2] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert sum(r.n_links for r in want) >= 0.9 * links.sum()


def test_warc(spark):
    html = "<p>" + "ä" * 600 + "</p>"
    rows = [(1, "http://a", html), (2, "http://b\r\nX: y", html), (3, None, html), (4, "http://d", None), (5, "", "short"),
            (6, "u", "short"), (None, "n", html), (9, "u", "x" * 3_000_000), (9, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"{warc_index.Rounds(spark, 'warc-test').base}/archives"
    index = warc_index.archive(pages, folder)
    assert index.count() == len(rows)
    out = warc_index.read_records(index, folder).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows) and by[3].record_type == "response" and bytes(by[3].payload) == html.encode()
    assert [(by[i].record_type, by[i].refers_to, bytes(by[i].payload)) for i in (1, 2, None)] == [("revisit", 3, b"")] * 3
    assert by[1].payload_bytes == len(html.encode()) and by[1].payload_digest == hashlib.sha1(html.encode()).hexdigest()
    assert by[5].record_type == by[6].record_type == "response" and by[4].payload_bytes == 0
    assert {i: by[i].url for i in (1, 2, 3, 5)} == {1: "http://a", 2: "http://b\r\nX: y", 3: "", 5: ""}
    shown = {r.page_id: r for r in warc_index.verified(warc_index.read_records(index, folder)).collect()}
    assert shown[1].payload_bytes == by[1].payload_bytes and shown[9].payload_bytes == 3_000_000
    without = index.where("page_id IS DISTINCT FROM 3")
    with pytest.raises(ValueError, match="3 revisit"):
        warc_index.verified(warc_index.read_records(without, folder))
    one = warc_index.read_records(index.where("page_id = 5"), folder).collect()
    assert [bytes(r.payload) for r in one] == [b"short"]
    assert warc_index.archive(pages.limit(0), folder).count() == 0


def test_many_tasks_read_one_archive(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a/%2F%0A%25?{i}", f"<p>{i}" * 400) for i in range(200)], "page_id long, url string, html string")
    folder = f"{warc_index.Rounds(spark, 'warc-test').base}/archives"
    index = warc_index.archive(pages.coalesce(1), folder)
    assert index.select("file").distinct().count() == 1
    monkeypatch.setattr(warc_index, "TASK_BYTES", 4_000)
    records = warc_index.read_records(index, folder)
    assert records.rdd.getNumPartitions() > 3
    assert {(r.page_id, r.url) for r in records.collect()} == {(i, f"http://a/%2F%0A%25?{i}") for i in range(200)}


def test_coalesced_ranges():
    near = [("a", 0, 10), ("a", 10, 10), ("a", 10**6, 5), ("b", 0, 5)]
    reads = list(warc_index.coalesced(near))
    assert [(f, s, e, len(p)) for f, s, e, p in reads] == [("a", 0, 20, 2), ("a", 10**6, 10**6 + 5, 1), ("b", 0, 5, 1)]


def test_simhash(spark, odd, empty):
    out = anchor_simhash.near_duplicates(odd)
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == 10
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[6].component_id == 5 and by[7].component_id == 7
    assert anchor_simhash.near_duplicates(empty).collect() == []
    kept = anchor_simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == rows_of(spark.createDataFrame([(1,), (2,), (5,), (7,), (BIG,), (None,)], "doc_id long"), "doc_id")
    assert anchor_simhash.keep_first(empty).collect() == []


@pytest.mark.parametrize("threshold, parts", [(4, anchor_simhash.GOLAY_PARTS), (7, anchor_simhash.HAMMING_PARTS), (2, anchor_simhash.GOLAY_PARTS)])
def test_no_close_pair_misses_its_anchor(threshold, parts):
    rng = np.random.default_rng(threshold)
    left = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    right = left.copy()
    for i in range(400):
        for b in rng.choice(64, threshold, replace=False):
            right[i] ^= np.uint64(1) << np.uint64(b)
    met = set()
    homes = {}
    for part, rows, anchor, home in anchor_simhash.anchors_of(left, threshold, parts):
        assert home.sum() == 400  # perfect codes: one nearest anchor each
        for r, a in zip(rows[home], anchor[home]):
            homes[(part, r)] = a
    for part, rows, anchor, _ in anchor_simhash.anchors_of(right, threshold, parts):
        met |= {int(r) for r, a in zip(rows, anchor) if homes[(part, r)] == a}
    assert met == set(range(400))


def test_crowded_anchors_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fps = [0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(300)]
    fps += [int(x) for x in rng.integers(0, 1 << 62, 100)]
    fps = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "node long, fps array<long>")
    monkeypatch.setattr(anchor_simhash, "BLOCK", 50)
    out = {r.id: r.component_id for r in anchor_simhash.link_fingerprints(nodes, 1, 4).collect()}
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(400):
        for j in range(i):
            if np.bitwise_count(np.uint64((fps[i] ^ fps[j]) % (1 << 64))) <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert out == {i: find(i) for i in range(400)}


def test_tiling(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    words = item.split()
    bench = spark.createDataFrame(
        [(1, item, "x"), (1, item, "x"), (2, None, "x"), (3, "too short", "x"), (None, item, "x"), (4, "z " * 40, "x")],
        "item_id long, text string, seed string",
    )
    docs = spark.createDataFrame([
        (1, f"start {item} end"), (2, " ".join(words[6:] + ["gap"] + words[:6])), (3, " ".join(words[:5])),
        (4, LONG + " " + item.upper()), (5, None), (6, ""), (None, item), (1, f"start {item} end"), (7, "z " * 3_000),
    ], "doc_id long, text string").withColumn("place", F.lit("p"))
    out = {(r.doc_id, r.item_id): r for r in string_tiling.contaminated(docs, bench).collect()}
    assert set(out) == {(1, 1), (2, 1), (4, 1), (7, 4)}
    assert out[(2, 1)].tiles == 2 and out[(2, 1)].coverage == 1.0 and out[(1, 1)].tiles == 1
    assert string_tiling.contaminated(empty, bench).collect() == []
    assert string_tiling.contaminated(docs, bench.limit(0)).collect() == []
    kept = corpus_pipeline.decontaminate  # rows without an id stay
    assert kept is not None and string_tiling.contaminated(odd, bench).collect() == []


def test_tiles_do_not_overlap():
    places, ats = np.array([0, 1, 2, 10, 11, 3]), np.array([0, 1, 2, 1, 2, 7])
    found = string_tiling.tiles(places, ats, 5)
    assert found[0] == (0, 0, 7)
    doc, item = set(), set()
    for place, at, size in found:
        assert not doc & set(range(place, place + size)) and not item & set(range(at, at + size))
        doc |= set(range(place, place + size))
        item |= set(range(at, at + size))


def test_scoring(spark, odd, empty):
    out = deleted_lm.score_documents(odd).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    assert by[2].n_tokens == 1 and by[3].n_tokens == 1 and by[4].n_tokens == 1 and by[5].n_tokens == 60_001
    assert None in by and BIG in by and not by[None].held_out
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert deleted_lm.score_documents(empty).collect() == []
    untrained = deleted_lm.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert untrained[0].train_tokens == 0 and untrained[0].n_known == 0


def test_probabilities_of_a_context_add_up():
    weights = deleted_lm.learn_weights(__import__("pandas").DataFrame({"bucket": [0, 3, 3], "q2": [-10_000, -8, -10_000], "q1": [-40, -30, -10_000], "n": [5, 9, 1]}), 100)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and (weights >= 0).all()
    assert weights[3, 0] > 0.5


def test_language(spark, odd, empty):
    parser = cross_parse.fit(odd)
    by = {r.doc_id: r for r in cross_parse.identify(odd, parser).collect()}
    assert by[1].lang_pred == "en" and by[7].lang_pred == "de" and by[5].lang_pred == "en"
    for i in (2, 3, 4, BIG):
        assert (by[i].lang_pred, by[i].score) == ("und", 0)
    assert all(0 <= r.score <= 1 for r in by.values())
    nothing = cross_parse.identify(odd, cross_parse.fit(empty))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert cross_parse.identify(empty, parser).collect() == []


def test_automaton_finds_every_substring():
    text = "abracadabra abbey"
    step = cross_parse.suffix_automaton(text)

    def holds(word):
        state = 0
        for c in word:
            state = step[state].get(c, -1)
            if state < 0:
                return False
        return True

    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            assert holds(text[i:j])
    assert not holds("abc") and not holds("ya")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, empty, name, stage):
    sf_dir = "/root/testdata/sf0.001"
    assert stage(spark, empty, sf_dir).collect() == []
    out = stage(spark, odd, sf_dir)
    assert out.count() > 0
    if (name, stage) != corpus_pipeline.STAGES[-1]:
        assert out.columns == odd.columns
