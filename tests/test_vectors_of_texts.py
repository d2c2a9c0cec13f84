"""TF-IDF models fitted on one corpus and applied to other texts."""

import math

from inkfield.plans import retrieval


def test_new_texts_under_a_fitted_model(spark):
    corpus = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None), (4, "b")], "doc_id long, text string")
    model = retrieval.tfidf_fit(corpus, "doc_id", 2)
    assert [(r["term"], r["place"]) for r in model.orderBy("place").collect()] == [("a", 0), ("b", 1)]
    idf = [math.log(5 / 2) + 1, math.log(5 / 4) + 1]
    new = spark.createDataFrame([(7, "A b x"), (8, "c c"), (9, None)], "item_id long, text string")
    got = {r["item_id"]: r["vector"] for r in retrieval.tfidf_vectors(model, new, "item_id").collect()}
    size = math.hypot(*idf)
    assert [round(x, 12) for x in got[7]] == [round(x / size, 12) for x in idf] and got[8] == got[9] == [0.0, 0.0]
    empty = retrieval.tfidf_fit(corpus.limit(0), "doc_id")
    assert {r["item_id"]: r["vector"] for r in retrieval.tfidf_vectors(empty, new, "item_id").collect()} == {7: [], 8: [], 9: []}
