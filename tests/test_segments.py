"""Tokens of whole batches, and searches that read no more than their queries need."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quarry import queries as Q
from quarry.functions import rank, segments
from quarry.functions import text as T
from quarry.functions.terms import TOKEN, split_token, tokenize
from quarry.operators import bm25, graph

ODD = ["", None, "12ab 3x4Y_z 7", "é12abc9é_x", "Ab aB AB if IF x " * 3, "9", "a9", "_", "XMLHttpRequest _a__b HTTPServer2x", " ".join(f"w{i % 230}_{i}" for i in range(400))]


def test_segments(monkeypatch):
    for size in (1 << 20, 8):
        monkeypatch.setattr(segments, "SLICE_BYTES", size)
        given, got = pa.array(["cut off", *ODD]).slice(1), [[] for _ in ODD]
        for at, to in segments.slices(given):
            s = segments.segment(given.slice(at, to - at), split_token, {})
            assert s.words.to_pylist() == sorted(set(s.words.to_pylist()))
            for i, w in zip(s.text.tolist(), s.word.tolist()):
                got[at + i].append(s.words[w].as_py())
        assert got == [tokenize(x or "") for x in ODD] and TOKEN


def test_postings_identifiers_and_hits(spark):
    rows = spark.createDataFrame([(i, x, f"a/b{i}.py", i, i, "class", x and x[:9], "en") for i, x in enumerate(ODD)] + [(4, ODD[4], "a/b4.py", 4, 4, "class", "x", "en")], "chunk_ord long, content string, file_path string, start_line int, end_line int, kind string, name string, language string")
    held, documents = bm25.index(rows), bm25.field_tokens(rows)
    plain = documents.select("field", "chunk_ord", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("field", "term", "chunk_ord", "dl").agg(F.count(F.lit(1)).alias("tf"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(held.postings, plain) and same(held.stats, bm25.field_stats(documents))  # a null content counts
    few = bm25.index(rows, spark.createDataFrame([("content", "ab"), ("name", "none")], "field string, term string"))
    assert same(few.postings, plain.where("field = 'content' AND term = 'ab'")) and same(few.stats, held.stats)
    assert same(graph.identifier_rows(rows).select("label", "chunk_ord"), rows.select(F.explode(graph.identifiers(F.col("content"))).alias("label"), "chunk_ord"))
    groups = [["ab", "zzz"], ["w1", "x"], ["xmlhttprequests"], ["class"], []]
    asked = rows.withColumn("query_id", F.lit(1)).withColumn("groups", F.array(*(F.array(*map(F.lit, g)).cast("array<string>") for g in groups)))
    meta = (F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))
    want = asked.select("chunk_ord", rank.concept_hits(F.col("groups"), T.metadata_tokens(*meta), T.tokens(F.col("content"))).alias("hits"))
    assert same(segments.with_hits(asked, F.concat_ws("\n", T.metadata_text(*meta), "content")).select("chunk_ord", "hits"), want)


def test_stated_queries_need_no_whole_index(spark, sf_dir, monkeypatch):
    """hybrid_search wrote the postings of all terms and the references of all chunks first."""
    monkeypatch.setattr(Q, "search_index", None)
    sizes = {}
    monkeypatch.setattr(bm25, "written", lambda df, name, *a, f=bm25.written: sizes.setdefault(name, f(df, name, *a)))
    assert Q.QUERY_FUNCTIONS["hybrid_search"](spark, sf_dir).count()
    assert sizes["postings"].select("term").distinct().count() < 100


def test_saved_index_is_made_in_its_place(spark, tmp_path, monkeypatch):
    """The postings were written twice, and sorted over the cluster. Chunks that share an id refer to a name once."""
    from quarry.operators import vectors
    from quarry.store import HybridIndex

    rows = spark.createDataFrame([(i, f"Alpha beta {i % 3} alpha Gamma_x", f"a/b{i % 4}.py", 1, 2, "class", "Alpha", "en") for i in range(6)], "chunk_ord long, content string, file_path string, start_line int, end_line int, kind string, name string, language string")
    names = []
    monkeypatch.setattr(bm25, "written", lambda df, name, *a, f=bm25.written: names.append(name) or f(df, name, *a))
    HybridIndex(rows, vectors.embedded(rows, F.col("content"), vectors.HashingModel()).select("chunk_ord", "embedding"), vectors.HashingModel()).save_to(f"file://{tmp_path}/index")
    assert "postings" not in names
    loaded = HybridIndex.load_from(spark, f"file://{tmp_path}/index")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    held = bm25.index(rows)
    assert same(loaded.held.postings, held.postings) and same(loaded.held.stats, held.stats) and same(loaded.held.terms, held.terms)
    refers = [(r["source_id"], r["target_id"]) for r in loaded.edges.where("kind = 'references'").collect()]
    assert len(refers) == len(set(refers)) == 4 * 3  # four ids, of which two have two chunks; alpha, beta, gamma_x
