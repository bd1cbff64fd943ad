"""The list interface."""

import json

import numpy as np
import pytest

from quarry import api

CHUNKS = [api.Chunk("def verify(): authenticate token", "src/auth.py", 1, 2, "function", "verify", "python"), api.Chunk("def render(): draw view", "src/view.py", 1, 2, "function", "render", "python")]


class Constant:
    def encode(self, texts, use_multiprocessing=None):
        return np.array([[1.0, 0.0] if "token" in t else [0.0, 1.0] for t in texts])


def test_bm25(spark):
    index = api.build_bm25_index(CHUNKS)
    for search, query in ((index.search, "authenticate"), (index.search_content, "token"), (index.search_name, "verify"), (index.search_path, "auth")):
        assert search(query)[0].chunk == CHUNKS[0]
    assert index.search(" ") == [] and index.search("x", 0) == [] and api.BM25Index([]).search("x") == [] and index.search("zzz") == []


def test_vectors(spark):
    index = api.build_vector_index(CHUNKS, Constant())
    assert [r.chunk for r in index.search("token")] == CHUNKS
    assert index.search_vector([0.0, 3.0], 1)[0].chunk == CHUNKS[1]
    with pytest.raises(ValueError, match="dimension"):
        index.search_vector([1.0])
    with pytest.raises(ValueError, match="same length"):
        api.VectorIndex.from_embeddings(CHUNKS, [[1.0]], None)
    with pytest.raises(ValueError, match="two-dimensional"):
        api.VectorIndex.from_embeddings(CHUNKS, [1.0, 2.0], None)


def test_hybrid_and_format(spark):
    found = api.build_hybrid_index([*CHUNKS, CHUNKS[0]], Constant()).search("authenticate token", 5)
    assert [r.chunk for r in found][0] == CHUNKS[0] and len(found) == 2
    out = json.loads(json.dumps(api.format_results("q", found)))
    assert out["results"][0]["chunk"]["location"] == "src/auth.py:1-2" and api.format_results("q", []) == {"query": "q", "results": []}


def test_graph_round_trip(spark, tmp_path):
    made = api.build_code_graph(CHUNKS)
    assert [n.id for n in made.nodes] == sorted(n.id for n in made.nodes)
    api.save_code_graph(tmp_path / "graph", made)
    api.save_code_graph(tmp_path / "graph", made)
    assert api.load_code_graph(tmp_path / "graph") == made


def test_chunks_and_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "root").mkdir()
    api.save_chunks_and_vectors(tmp_path / "root", CHUNKS, [[1.0, 0.0], [0.0, 1.0]])
    chunks, found = api.load_chunks_and_vectors(tmp_path / "root")
    assert list(chunks) == CHUNKS and found.tolist() == [[1.0, 0.0], [0.0, 1.0]]
    assert api.index_exists(tmp_path / "root") and not (api.index_dir(tmp_path / "root") / "none").exists()
    index = api.load_or_build_hybrid_index(tmp_path / "root", Constant())
    assert index.search("token")[0].chunk == CHUNKS[0]


def test_jsonl(spark, tmp_path):
    api.write_jsonl(api.frame([*CHUNKS, api.Chunk("é\n", "a.py", 1, 1)]), str(tmp_path / "out"))
    got = sorted(api.read_jsonl(str(tmp_path / "out")).collect(), key=lambda r: r["file_path"])
    assert got[0]["content"] == "é\n" and got[0]["name"] is None and got[1]["name"] == "verify"
    (tmp_path / "odd.jsonl").write_text('{"content": "x", "file_path": "b.py", "start_line": 1, "end_line": 2, "kind": "file", "name": 5, "language": null}\n\n')
    row = api.read_jsonl(str(tmp_path / "odd.jsonl")).collect()
    assert len(row) == 1 and row[0]["name"] is None and row[0]["start_line"] == 1


def test_sources(tmp_path, spark):
    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    assert [c.name for c in api.scan_chunks(tmp_path)] == ["f"]
    assert api.chunk_source("def f():\n    pass\n", "a.py")[0].kind == "function"


def test_public_names():
    import quarry

    assert len(quarry.__all__) == 17 and all(getattr(quarry, x) is getattr(api, x) for x in quarry.__all__)
    with pytest.raises(AttributeError):
        quarry.nothing  # noqa: B018


def test_own_indexes(spark):
    """Indexes that lack methods take part with what they have."""

    class Plain:
        chunks = CHUNKS

        def search(self, query, top_k=5):
            return [api.SearchResult(c, 1.0) for c in CHUNKS[:2]]

    class Nothing:
        pass

    assert api.first_chunks(Nothing(), Plain()) == tuple(CHUNKS) and api.first_chunks(Nothing()) == ()
    assert api.field_hits(Nothing(), "search_name", "x", 3) == [] and len(api.field_hits(Plain(), "search_content", "x", 3, "search")) == 2
    found = api.HybridIndex.from_indexes(Plain(), Nothing()).search("zzz yyy", 5)
    assert {x.chunk for x in found} == set(CHUNKS[:2]) and [x.score for x in found] == sorted((x.score for x in found), reverse=True)
    whole = api.HybridIndex.from_indexes(api.build_bm25_index(CHUNKS), api.build_vector_index(CHUNKS)).search("how are sessions kept", 5)
    assert [x.chunk for x in whole] == [x.chunk for x in api.build_hybrid_index(CHUNKS).search("how are sessions kept", 5)]
