"""Indexes in files: chunks with their vectors, postings, the graph and metadata, one directory a project.

All files are read, written and looked for through Spark's file systems, so the home may be a folder of any store that all
executors share. The default one is for a single machine.
"""

from __future__ import annotations

import functools
import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import embedding_text
from quarry.operators import bm25, graph, vectors
from quarry.plans import hybrid
from quarry.shared import path_exists, read_text, write_text, written
from quarry.sources import tree

HOME = Path("~/.quarry")


def project_key(root: str) -> str:
    return hashlib.sha256(str(Path(root).expanduser().resolve()).encode()).hexdigest()


def index_dir(root: str, home: str | Path = HOME) -> str:
    """A home that is a Path, or a string without a scheme, is a folder of this machine."""
    base = str(home) if "://" in str(home) else Path(home).expanduser().resolve().as_uri()
    return f"{base.rstrip('/')}/chunk/{project_key(tree.checked_root(root))}"


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("quarry").getOrCreate()


class HybridIndex:
    """chunks (chunk_ord, CHUNK), embeddings (chunk_ord, embedding), the BM25 frames, nodes and edges."""

    def __init__(self, chunks: DataFrame, embeddings: DataFrame, model: vectors.Model, held: bm25.Index | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        self.chunks, self.embeddings, self.model = chunks, embeddings, model
        self._held, self._nodes, self._edges = held, nodes, edges

    # what isn't given is made when it is first needed, so an index that is only saved is made in its place

    @functools.cached_property
    def _imports(self) -> DataFrame:
        return written(graph.imports(self.chunks), "imports")

    @functools.cached_property
    def held(self) -> bm25.Index:
        return self._held or bm25.index(self.chunks)

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return graph.nodes(self.chunks, self._imports) if self._nodes is None else self._nodes

    @functools.cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.chunks, self._imports) if self._edges is None else self._edges

    @functools.cached_property
    def links(self) -> graph.Lookup:
        return graph.lookup(self.chunks, self.edges)

    @classmethod
    def from_chunks(cls, chunks: DataFrame, model: vectors.Model | None = None) -> HybridIndex:
        model = model or vectors.HashingModel()
        text = embedding_text(F.col("content"), F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))
        return cls(chunks, vectors.embedded(chunks.select("chunk_ord", text.alias("text")), F.col("text"), model).select("chunk_ord", "embedding"), model)

    @classmethod
    def from_embeddings(cls, chunks: DataFrame, embeddings: DataFrame, model: vectors.Model) -> HybridIndex:
        """Vectors must be one for each chunk, and of one length."""
        size = F.size("embedding")
        row = chunks.select("chunk_ord").join(embeddings, "chunk_ord", "full").agg(F.count_if(F.col("embedding").isNull()).alias("without"), F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).first()
        if row["without"] or row["n"] != chunks.count():
            raise ValueError("chunks and embeddings must have the same length")
        if row["low"] != row["high"]:
            raise ValueError("embeddings must be a two-dimensional array")
        return cls(chunks, embeddings, model)

    def search(self, query: str, top_k: int = 10, alpha: float | None = None, penalize_paths: bool = True) -> DataFrame:
        """rank, score and the chunk's columns, by rank; empty for a blank query or top_k under 1."""
        return self.search_batch([query], top_k, alpha, penalize_paths).drop("query_id").orderBy("rank")

    def search_batch(self, queries: list[str], top_k: int = 10, alpha: float | None = None, penalize_paths: bool = True) -> DataFrame:
        spark = self.chunks.sparkSession
        if top_k < 1 or not any(q.strip() for q in queries):
            return hybrid.search(self.chunks.limit(0), hybrid.query_frame(spark, ["none"]), None, 1).limit(0)
        asked = hybrid.query_frame(spark, queries, alpha)
        rows = asked.select("query_id", "search_text", "expand").collect()
        found = vectors.embed_texts(self.model, [r["search_text"] for r in rows])
        hits = vectors.cosine_top(self.embeddings, [(r["query_id"], v) for r, v in zip(rows, found)], max(10 * top_k, 100))
        return hybrid.search(self.chunks, asked, hits, top_k, penalize_paths, self.links, any(r["expand"] for r in rows), self.held)

    def save(self, root: str, home: str | Path = HOME, model_name: str = "hashing") -> None:
        self.save_to(index_dir(root, home), {"root_path": tree.checked_root(root), "root_path_sha256": project_key(root), "created_at": time.time(), "model_name": model_name})

    def save_to(self, to: str, about: dict[str, object] | None = None) -> None:
        """Postings lie in segments, each sorted by field and term; the lengths are among them, as those of no term. The metadata comes last: an index without them isn't whole."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{to}/chunks")
        self.embeddings.write.mode("overwrite").parquet(f"{to}/vectors")
        if held := self.__dict__.get("held", self._held):
            held.postings.write.mode("overwrite").parquet(f"{to}/postings")
        else:
            bm25.postings(self.chunks).write.mode("overwrite").parquet(f"{to}/postings")
            held = bm25.index_of(spark.read.parquet(f"{to}/postings"), self.chunks)
        held.stats.write.mode("overwrite").parquet(f"{to}/stats")
        held.terms.write.mode("overwrite").parquet(f"{to}/terms")
        self.nodes.write.mode("overwrite").parquet(f"{to}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{to}/edges")
        read = lambda name: spark.read.parquet(f"{to}/{name}")
        n = read("chunks").count()
        width = read("vectors").agg(F.max(F.size("embedding"))).first()[0] or 0
        meta = (about or {}) | {"chunk_count": n, "vector_shape": [n, width], "graph_node_count": read("nodes").count(), "graph_edge_count": read("edges").count()}
        write_text(spark, f"{to}/metadata.json", json.dumps(meta, ensure_ascii=False, indent=2))

    @classmethod
    def load(cls, spark: SparkSession, root: str, home: str | Path = HOME, model: vectors.Model | None = None) -> HybridIndex:
        return cls.load_from(spark, index_dir(root, home), model)

    @classmethod
    def load_from(cls, spark: SparkSession, to: str, model: vectors.Model | None = None) -> HybridIndex:
        """The graph is made again, and saved, where it is missing."""
        read = lambda name: spark.read.parquet(f"{to}/{name}")
        chunks = read("chunks")
        for name, make in (("nodes", graph.nodes), ("edges", graph.edges)):
            if not path_exists(spark, f"{to}/{name}"):
                make(chunks).write.parquet(f"{to}/{name}")
        held = bm25.Index(read("postings").where("term IS NOT NULL"), read("stats"), read("terms"))
        return cls(chunks, read("vectors"), model or vectors.HashingModel(), held, read("nodes"), read("edges"))


def index_exists(root: str, home: str | Path = HOME) -> bool:
    """Chunks, vectors and metadata are there, and made for this root."""
    spark, to = _session(), index_dir(root, home)
    try:
        meta = json.loads(read_text(spark, f"{to}/metadata.json") or "null")
    except json.JSONDecodeError:
        return False
    return isinstance(meta, dict) and meta.get("root_path_sha256") == project_key(root) and path_exists(spark, f"{to}/chunks") and path_exists(spark, f"{to}/vectors")


def load_or_build(spark: SparkSession, root: str, model: vectors.Model | None = None, rebuild: bool = False, home: str | Path = HOME) -> HybridIndex:
    if rebuild or not index_exists(root, home):
        HybridIndex.from_chunks(tree.scan(spark, root), model).save(root, home)
    return HybridIndex.load(spark, root, home, model)
