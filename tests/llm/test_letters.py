"""Language identification over many letters."""

import random

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from paperweave.llm import cross_parse


def language(first, letters, words, seed):
    """A random vocabulary over `letters` letters from code point `first` on, and a source of its sentences."""
    rng = random.Random(seed)
    every = [chr(c) for c in range(first, first + 4 * letters) if chr(c).isalpha() and chr(c).lower() == chr(c)][:letters]
    assert len(every) == letters
    vocabulary = ["".join(rng.choices(every, k=3)) for _ in range(words)]
    return lambda n: " ".join(rng.choices(vocabulary, k=n))


def plain_phrases(step, text):
    """Phrases of greedy parsing, symbol by symbol."""
    count = state = 0
    for c in text:
        if c in step[state]:
            state = step[state][c]
            continue
        count += state > 0
        state = step[0].get(c, 0)
        count += not state
    return count + (state > 0)


def learned(sources):
    samples = {lang: [source(40) for _ in range(60)] for lang, source in sources.items()}
    edges = [cross_parse._edges(pd.DataFrame({"rank": range(60), "text": t, "lang": lang})) for lang, t in samples.items()]
    return cross_parse.Parser(pd.concat(edges)), edges


def check(sources):
    parser, edges = learned(sources)
    texts = {lang: [source(30) for _ in range(20)] for lang, source in sources.items()}
    steps = []
    for frame in edges:
        step = [{} for _ in range(int(frame["target"].max()) + 1)]
        for s, c, t in zip(frame["state"], frame["symbol"], frame["target"]):
            step[s][c] = t
        steps.append((frame["lang"].iloc[0], step))
    for lang, own in texts.items():
        said = parser.judge(own)
        assert set(said["lang_pred"]) == {lang}
        assert (said["phrase_length"] >= corpus_pipeline.MIN_PHRASE).all()
        found, _, _ = parser.phrases(own)
        for other, step in steps:
            assert found[:, parser.langs.index(other)].tolist() == [plain_phrases(step, t) for t in own]
    return parser


def test_two_languages_of_several_hundred_letters():
    parser = check({"a1": language(0x4E00, 700, 300, 1), "a2": language(0x4E00, 700, 300, 2)})
    assert len(parser.letters) > 400


def test_three_scripts_together():
    parser = check({
        "el": language(0x3B1, 24, 200, 3), "en": language(0x61, 26, 200, 4), "ru": language(0x430, 32, 200, 5),
        "de": language(0x61, 26, 200, 6), "uk": language(0x430, 32, 200, 7),
    })
    assert len(parser.letters) == 24 + 26 + 32


def test_letters_no_language_knows_cost_a_phrase_each():
    parser, _ = learned({"a1": language(0x4E00, 700, 300, 1), "en": language(0x61, 26, 200, 4)})
    said = parser.judge(["абвгд" * 5])
    assert said["phrase_length"][0] == 1


def test_repeats_of_a_document_leave_room_for_others(spark):
    """A document on hundreds of rows is one of the sample, whatever its id hashes to."""
    source = language(0x61, 26, 200, 4)
    docs = spark.createDataFrame([(i, source(40), "en") for i in range(60)], "doc_id long, text string, lang string")
    lowest = docs.orderBy(F.xxhash64("doc_id"), "doc_id").first()
    repeats = spark.createDataFrame([tuple(lowest)] * 300, docs.schema)
    one, many = cross_parse.fit(docs), cross_parse.fit(docs.unionAll(repeats))
    assert many.letters == one.letters and all((a == b).all() for a, b in zip(one.tables, many.tables, strict=True))
