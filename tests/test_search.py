"""Searches over small sets of chunks: BM25, vectors, fusion, filters, graph expansion, and the whole."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, graph, vectors
from quarry.plans import hybrid
from quarry.schema import CHUNK, Bm25
from quarry.store import HybridIndex


class MapModel:
    def __init__(self, given, default):
        self.given, self.default = given, default

    def encode(self, texts):
        return np.array([next((v for k, v in self.given.items() if k in t), self.default) for t in texts], np.float32)


def frame(spark, rows):
    """rows: (content, path, kind, name), one line each."""
    return spark.createDataFrame([(i, c, p, i + 1, i + 1, k, n, "python") for i, (c, p, k, n) in enumerate(rows)], f"chunk_ord long, {CHUNK}")


def index(spark, rows, given=None, default=(1.0, 0.0)):
    return HybridIndex.from_chunks(frame(spark, rows), MapModel(given or {}, default))


def paths_of(df):
    return [r["file_path"] for r in df.collect()]


AUTH = [("def verify(): authenticate token", "src/auth.py", "function", None), ("def render(): draw view", "src/view.py", "function", None)]


def field(spark, rows, query, name):
    return [r["chunk_ord"] for r in bm25.search_fields(frame(spark, rows), hybrid.query_frame(spark, [query]), 5, (name,)).orderBy("rank").collect()]


def test_bm25_fields(spark):
    assert field(spark, AUTH, "authenticate token", "content") == [0]
    same = [("x = 1", "src/cache/store.py", "file", None), ("x = 1", "src/http/client.py", "file", None)]
    assert field(spark, same, "cache", "path") == [0]
    assert field(spark, [("a", "src/context.py", "file", None), ("b", "src/view.py", "file", None)], "ctx", "path") == [0]
    assert field(spark, [("a", "a.py", "function", "build"), ("b", "b.py", "class", "ParamType")], "param type", "name") == [1]
    assert field(spark, AUTH, "nothing here matches zzz", "content") == []


def test_bm25_score(spark):
    rows = frame(spark, [("alpha beta alpha", "a.py", "file", None), ("beta gamma", "b.py", "file", None), ("", "c.py", "file", None)])
    got = {r["chunk_ord"]: r["score"] for r in bm25.search_fields(rows, hybrid.query_frame(spark, ["alpha"]), 5, ("content",)).collect()}
    idf, avg = math.log(1 + (3 - 1 + 0.5) / 1.5), 5 / 3
    assert got == {0: pytest.approx(idf * 2 / (Bm25.k1 * (0.25 + 0.75 * 3 / avg) + 2), abs=1e-8)}


def test_bm25_combined_ties_by_field(spark):
    rows = [("zebra", "a.py", "file", None), ("none", "zebra.py", "file", None), ("none", "b.py", "function", "zebra")]
    got = bm25.search_combined(frame(spark, rows), hybrid.query_frame(spark, ["zebra"]), 5).orderBy("rank").collect()
    assert [(r["chunk_ord"], round(r["score"], 3)) for r in got] == [(2, 6.0), (1, 3.0), (0, 1.0)]


def test_cosine(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1.0, 0.0]), (3, [3.0, 0.0])], "chunk_ord long, embedding array<float>")
    got = vectors.cosine_top(rows, [(7, [2.0, 0.0])], 4).orderBy("rank").collect()
    assert [(r["chunk_ord"], r["score"]) for r in got] == [(0, 1.0), (3, 1.0), (1, 0.0), (2, -1.0)]
    with pytest.raises(Exception, match="dimension"):
        vectors.cosine_top(rows, [(7, [2.0, 0.0, 1.0])], 4).collect()


def test_embedding_checks(spark):
    class Flat:
        def encode(self, texts):
            return np.ones(len(texts))

    with pytest.raises(ValueError, match="two-dimensional"):
        vectors.embed_texts(Flat(), ["a"])
    assert vectors.embed_texts(Flat(), []).shape == (0, 0)
    chunks = frame(spark, AUTH)
    with pytest.raises(ValueError, match="same length"):
        HybridIndex.from_embeddings(chunks, spark.createDataFrame([(0, [1.0])], "chunk_ord long, embedding array<float>"), None)


def test_hybrid_merges_and_checks_alpha(spark):
    held = index(spark, AUTH, {"view": (0.0, 1.0)})
    assert paths_of(held.search("authenticate token", 2))[0] == "src/auth.py"
    assert held.search("  ").count() == 0 and held.search("x", 0).count() == 0
    with pytest.raises(ValueError, match="alpha"):
        held.search("token", alpha=1.5)
    assert paths_of(held.search("view", 1, alpha=1.0)) == ["src/view.py"]


def test_symbol_query_prefers_definition(spark):
    rows = [("class Command: pass", "src/core.py", "class", "Command"), ("command command command usage", "src/use.py", "module", None)]
    assert paths_of(index(spark, rows).search("Command", 2))[0] == "src/core.py"


def test_path_penalty(spark):
    rows = [("token check", "src/_impl.py", "function", None), ("token check", "src/impl.py", "function", None)]
    held = index(spark, rows)
    assert paths_of(held.search("token", 2))[0] == "src/impl.py"
    assert paths_of(held.search("token", 2, penalize_paths=False))[0] == "src/_impl.py"


def test_exact_name_first(spark):
    rows = [("class CacheBuilderFactory", "src/a.py", "class", "CacheBuilderFactory"), ("class CacheBuilder", "src/b.py", "class", "CacheBuilder")]
    assert [r["name"] for r in index(spark, rows).search("CacheBuilder", 2).collect()][0] == "CacheBuilder"


def test_filters(spark):
    rows = [("token function", "src/auth/f.py", "function", "f"), ("token class", "src/auth/c.py", "class", "C")]
    assert paths_of(index(spark, rows).search("kind:class path:auth token", 5)) == ["src/auth/c.py"]


def test_recall_by_path_and_name(spark):
    """A chunk that only its path or its name gives away is found among 130 that only their content does."""
    cases = [("cache", ("read()", "src/cache/store.py", "module", None), "cache cache"), ("CacheBuilder", ("return value", "src/factory.py", "class", "CacheBuilder"), "CacheBuilder CacheBuilder")]
    for query, target, filler in cases:
        rows = [target] + [(filler, f"src/fillers/item_{i}.py", "function", None) for i in range(130)]
        got = hybrid.search(frame(spark, rows), hybrid.query_frame(spark, [query], 0.0), None, 3)
        assert target[1] in paths_of(got)


def test_saturation(spark):
    rows = spark.createDataFrame([(0, i, "src/core.py" if i < 4 else "src/other.py", i, 10.0 - i) for i in range(5)], "query_id long, chunk_ord long, file_path string, start_line int, score double")
    assert "src/other.py" in [r["file_path"] for r in hybrid.saturated(rows, 3).collect()]


def test_coherence(spark):
    rows = spark.createDataFrame([(0, 0, "a", 1, 1.0), (0, 1, "a", 2, 0.5), (0, 2, "b", 1, 1.0)], "query_id long, chunk_ord long, file_path string, start_line int, score double")
    assert {r["chunk_ord"]: round(r["score"], 6) for r in hybrid.coherent(rows).collect()} == {0: 1.15, 1: 0.5, 2: 1.1}


def test_expansion_brings_caller_and_definition(spark):
    rows = [("def run():\n    verify_token(x)", "src/app.py", "function", "run"), ("def verify_token(x): pass", "src/auth.py", "function", "verify_token"), ("nothing", "src/other.py", "function", "other")]
    got = paths_of(index(spark, rows).search("callers of verify_token", 3))
    assert {"src/app.py", "src/auth.py"} <= set(got)


def test_expansion_is_sequential(spark):
    """Against the loop that it stands for, on random graphs."""
    rng = np.random.default_rng(3)
    for _ in range(3):
        n = 12
        scores = {i: round(float(rng.random()) / 10, 3) for i in range(n)}
        boost = {(i, j): float(rng.choice([0.22, 0.35, 0.16])) * 8 for i in range(n) for j in range(n) if i != j and rng.random() < 0.25}
        want = dict(scores)
        for s in sorted(scores, key=lambda i: (-scores[i], i)):
            for (a, b), x in boost.items():
                if a == s:
                    want[b] = max(want[b], want[s] * x)
        scored = spark.createDataFrame([(0, i, s) for i, s in scores.items()], "query_id long, chunk_ord long, score double")
        seeds = graph.seeds_of(scored, ["chunk_ord"])
        links = spark.createDataFrame([(a, b, x) for (a, b), x in boost.items()], "seed long, chunk_ord long, boost double")
        got = {r["chunk_ord"]: r["score"] for r in graph.expand(scored, seeds, links).collect()}
        assert got == pytest.approx(want)


def test_clear(spark):
    from quarry import shared

    kept = shared._WRITTEN[:]
    shared._WRITTEN.clear()
    out = shared.written(spark.range(5), "five")
    path, before = shared._WRITTEN[0], shared.cleared()
    assert out.count() == 5 and shared.path_exists(spark, path)
    shared.clear(spark)
    assert not shared.path_exists(spark, path) and shared.cleared() == before + 1
    shared._WRITTEN.extend(kept)
