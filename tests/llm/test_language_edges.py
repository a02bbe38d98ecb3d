"""Languages of few and short documents."""

import corpus_pipeline
from formweave.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_language_of_one_short_word_is_learned(spark):
    docs = spark.createDataFrame([(1, "你好", "zh"), (2, "ok", "xx"), *[(i, f"some words of plain text {i}", "en") for i in range(3, 9)]], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert sorted(model) == ["en", "xx", "zh"] and all(len(c) >= 8 for c in model.values())
    assert language.classify(docs, model).count() == 8


def test_rows_stay_where_no_language_is_known(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["a text", "other words", None, ""])], SCHEMA)
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 4
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0
