"""Batches that go to Python workers."""

import re

from evidentia.llm import langid


def test_texts_go_to_the_language_workers_once(spark):
    docs = spark.createDataFrame([(1, "eins zwei drei", "de"), (2, "one two three", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    done = langid.predict(docs, langid.train(docs))
    sent = re.findall(r"text#\d+ AS ", done._jdf.queryExecution().analyzed().toString())
    assert len(sent) == 1
    assert [(r["doc_id"], r["text"]) for r in done.orderBy("doc_id").collect()] == [(1, "eins zwei drei"), (2, "one two three"), (3, None)]
