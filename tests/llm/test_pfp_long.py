"""Phrases without a trigger for more than a string's length."""

from __future__ import annotations

from collections import Counter

from quarry.llm import pfp
from tests.llm.test_corpus import dedup_of


def test_long_phrases(spark):
    """Two that begin alike were taken for one, and so their strings beyond the first 200 bytes."""
    texts = ["x" * 260 + "A" + "x" * 150 + "1", "x" * 260 + "B" + "x" * 150 + "2", "x" * 260 + "A" + "x" * 150 + "1", "ab" * 170 + "c", "ab" * 170 + "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = dedup_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(tuple(r) for r in pfp.dedup(docs).collect()) == want
