"""Dictionary matching by automaton and by joins against a plain version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperweave.functions.text import normalize_text
from paperweave.operators import attribution
from paperweave.plans.graph_queries import nation_aliases
from paperweave.plans.views import Views


def rows(df):
    return sorted((tuple(r[c] for c in ("name", "country_code", "code", "score")) for r in df.collect()), key=repr)


def plain(names, entries):
    out = {}
    for name, country in set(names):
        for code, own, alias in entries:
            if not name or not alias:
                continue
            base = 120 if name == alias else 100 if alias in name else 80 if name in alias and len(name) >= 10 else 0
            if base:
                base += 10 if own is not None and own == country else -25 if own and country and own != country else 0
                key = (name, country, code)
                out[key] = max(out.get(key, base), base)
    return sorted(((*k, v) for k, v in out.items()), key=repr)


@pytest.mark.parametrize("limit", [attribution.DICTIONARY_CHARS, 0])
def test_both_ways_give_the_pairs_that_contain_each_other(spark, limit):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    names = [(text(rng.randrange(1, 6)), rng.choice([None, "IT", "SE"])) for _ in range(120)] + [("", None), (None, None), ("a", None), ("a", None)]
    entries = [(f"c{i % 7}", rng.choice([None, "", "IT"]), text(rng.randrange(1, 8))) for i in range(60)] + [("c1", None, "a"), ("c2", None, ""), ("c3", None, None)]
    names_df = spark.createDataFrame(names, "name string, country_code string")
    dictionary = spark.createDataFrame(entries, "code string, country_code string, alias string")
    normal = {r.alias: r.n for r in dictionary.select("alias", normalize_text(F.col("alias")).alias("n")).collect()}
    want = plain(names, [(code, own, normal[alias] or "") for code, own, alias in entries])
    assert want and rows(attribution.alias_match(names_df, dictionary, dictionary_chars=limit)) == want
    assert rows(attribution.alias_match(names_df, dictionary.limit(0), dictionary_chars=limit)) == []
    assert rows(attribution.alias_match(names_df.limit(0), dictionary, dictionary_chars=limit)) == []


def test_both_ways_agree_on_organizations(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    names = v.organization().select(normalize_text(F.col("name")).alias("name"), F.lit("IT").alias("country_code"))
    small, large = (rows(attribution.alias_match(names, nation_aliases(v), dictionary_chars=n)) for n in (10**6, 0))
    assert small and small == large
