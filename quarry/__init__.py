"""Retrieval over code and text on Spark. The names of the public interface are taken from quarry.api when they are asked for, so workers that import one operator don't import them all."""

from __future__ import annotations

__all__ = [
    "BM25Index", "Chunk", "CodeGraph", "GraphEdge", "GraphNode", "HybridIndex", "SearchResult", "VectorIndex", "build_bm25_index", "build_code_graph", "build_hybrid_index", "build_vector_index",
    "chunk_source", "format_results", "load_embedding_model", "load_or_build_hybrid_index", "scan_chunks",
]


def __getattr__(name: str) -> object:
    if name in __all__:
        from quarry import api

        return getattr(api, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
