"""Embedding texts take their own authors only; each text is split once."""

from paperweave.operators import embeddings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_name_their_own_authors_only_and_are_split_once(spark):
    docs = spark.createDataFrame([(1, "a b b", "c"), (2, "b", None), (3, None, None)], "publication_id long, title string, abstract string")
    links = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (90, 7, 1)], "publication_id long, researcher_id long, author_position int")
    people = spark.createDataFrame([(7, "Ann"), (8, "Bob")], "researcher_id long, full_name string")
    texts = embeddings.embedding_text(docs, links, people)
    assert {r.publication_id: r.content_text for r in texts.collect()} == {
        1: "Title: a b b\n\nAuthors: Ann, Bob\n\nAbstract: c", 2: "Title: b", 3: None}
    assert "LeftSemi" in plan(texts)
    weights = embeddings.tfidf_weights(texts)
    assert "Generate" not in plan(weights)
    given = embeddings.tfidf_vectors(texts, weights=weights).collect()
    assert sorted(map(str, given)) == sorted(map(str, embeddings.tfidf_vectors(texts).collect())) and len(given) == 2
