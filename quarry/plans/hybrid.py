"""Hybrid search: five ranked channels, fused by reciprocal ranks, widened over the graph, filtered and ranked by rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import paths, rank
from quarry.functions import text as T
from quarry.functions.segments import with_hits
from quarry.functions.terms import QUERY, query_row
from quarry.operators import bm25, graph, vectors
from quarry.operators.bm25 import DIGITS
from quarry.schema import CHUNK_COLUMNS, COHERENCE, RECALL, RRF_K, SATURATION, TINY
from quarry.shared import written

#: Channels in the order that breaks ties.
CHANNELS = ("content", "vector", "name", "path", "symbol")


def query_frame(spark: SparkSession, queries: Sequence[str], alpha: float | None = None) -> DataFrame:
    """A row for each query, numbered from 0; blank ones are left out."""
    return spark.createDataFrame([query_row(i, q, alpha) for i, q in enumerate(queries) if q.strip()], QUERY)


def parse_batch(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The queries of a table, parsed by the workers."""

    def run(given):  # noqa: ANN001, ANN202
        import pandas as pd

        for frame in given:
            found = [query_row(int(k), t) for k, t in zip(frame[key], frame[text]) if t and t.strip()]
            yield pd.DataFrame(found, columns=[x.strip().split(" ")[0] for x in QUERY.split(", ")])

    return rows.select(key, text).mapInPandas(run, QUERY)


def columns(df: DataFrame, names: Sequence[str]) -> dict:
    return {n: F.col(n) for n in names if n in df.columns}


def name_keys(chunks: DataFrame) -> DataFrame:
    """chunk_ord, key: an index of names, by which symbol_channel finds all that may gain a bonus. Keys are a name as a whole, its parts of up to three letters, and its tokens' beginnings."""
    names = chunks.where(F.coalesce("name", F.lit("")) != "").select("chunk_ord", T.compact(F.col("name")).alias("n"), T.tokens(F.col("name")).alias("t"))
    part = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - (size - 1), F.lit(1))), lambda i: F.concat(F.lit("p:"), F.substr("n", i, F.lit(size))))
    keys = F.concat(F.array(F.concat(F.lit("w:"), F.col("n"))), part(1), part(2), part(3), F.transform("t", lambda x: F.concat(F.lit("t:"), F.substring(x, 1, 3))))
    return names.select("chunk_ord", F.explode(F.array_distinct(keys)).alias("key"))


def symbol_channel(chunks: DataFrame, queries: DataFrame, k: int, keys: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_ord, score. keys: name_keys(chunks).

    A bonus needs a name that is one of the query's words, or holds the whole query and so its first letters, or a token
    for each term and so for the first: one starts with the other's first letters then. By such keys queries meet names;
    the rule itself then judges these.
    """
    asked = queries.select("query_id", "search_text", "compact", "word_compacts", "raw_terms")
    begin = lambda x: F.concat(F.lit("t:"), F.substring(x, 1, 3))
    wanted = F.concat(
        F.transform("word_compacts", lambda x: F.concat(F.lit("w:"), x)),
        F.when(F.col("compact") != "", F.array(F.concat(F.lit("p:"), F.substring("compact", 1, 3)))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("raw_terms") > 1, F.array(begin(F.get("raw_terms", F.lit(0))))).otherwise(F.array().cast("array<string>")),
    )
    met = asked.select("query_id", F.explode(F.array_distinct(wanted)).alias("key")).join(name_keys(chunks) if keys is None else keys, "key").select("query_id", "chunk_ord").distinct()
    met = written(met, "met")
    both = met.join(chunks.select("chunk_ord", "content", "kind", "name"), "chunk_ord").join(asked, "query_id")
    both = both.where(rank.name_bonus(F.col("name"), F.col("search_text"), F.col("compact"), F.col("word_compacts"), F.col("raw_terms")) > 0)
    scored = both.select("query_id", "chunk_ord", F.round(rank.symbol_score(columns(both, both.columns), columns(both, both.columns)), DIGITS).alias("score"))
    return bm25.top(scored, k, ["query_id"], ["chunk_ord"]).select("query_id", "rank", "chunk_ord", "score")


def fuse(channels: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """query_id, chunk_ord, score, first: the sum of weight / (60 + rank). channels: query_id, chunk_ord, rank each, a chunk once. first: its place in the order of channels and ranks."""
    parts = [df.select("query_id", "chunk_ord", "rank", F.lit(i).alias("channel")) for i, df in enumerate(channels.values())]
    given = F.array(*(F.col(f"w_{c}") for c in channels))
    rows = reduce(DataFrame.unionByName, parts).join(queries.select("query_id", given.alias("w")), "query_id")
    rows = rows.withColumn("w", F.get("w", F.col("channel"))).where("w > 0")
    return rows.groupBy("query_id", "chunk_ord").agg(F.round(F.sum(F.col("w") / (RRF_K + F.col("rank"))), 12).alias("score"), F.min(F.struct("channel", "rank")).alias("first"))


def coherent(scored: DataFrame) -> DataFrame:
    """The best chunk of each file gains a share of the query's best score, by the file's total over the greatest total. scored: query_id, chunk_ord, file_path, start_line, score."""
    best = F.min(F.struct((-F.col("score")).alias("less"), "start_line", "chunk_ord"))
    files = scored.groupBy("query_id", "file_path").agg(F.round(F.sum("score"), 12).alias("_total"), F.max("score").alias("_top"), best["chunk_ord"].alias("_best"))
    whole = files.groupBy("query_id").agg(F.max("_top").alias("_most"), F.max("_total").alias("_most_total"))  # a row a query
    rows = scored.join(files.drop("_top"), ["query_id", "file_path"]).join(whole, "query_id")
    gain = F.when((F.col("chunk_ord") == F.col("_best")) & (F.col("_most") > 0) & (F.col("_most_total") > 0), F.col("_most") * COHERENCE * F.col("_total") / F.col("_most_total")).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + gain).drop("_total", "_best", "_most", "_most_total")


def saturated(scored: DataFrame, k: int) -> DataFrame:
    """Each file's second chunk counts 0.65 times, its third 0.65 times that; then the k best. Adds `rank`."""
    tie = ["file_path", "start_line", "chunk_ord"]
    scored = scored.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    nth = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.col("score").desc(), "start_line", "chunk_ord"))
    rows = scored.withColumn("_n", nth).withColumn("_old", F.col("score")).withColumn("score", F.round(F.col("score") * F.pow(F.lit(SATURATION), F.col("_n") - 1), DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_old").desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_n", "_old")


def expanded(fused: DataFrame, queries: DataFrame, chunks: DataFrame, held: graph.Lookup) -> DataFrame:
    """query_id, chunk_ord, score, with the neighbours of the best chunks of queries that ask for relations. fused: written, as several joins read it."""
    seeds = written(graph.seeds_of(fused.join(queries.where("expand").select("query_id"), "query_id"), ["first"]), "seeds")
    links = written(graph.seed_links(seeds, chunks, held), "links")
    return graph.expand(fused.select("query_id", "chunk_ord", "score"), seeds, links)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    vector_hits: DataFrame | None = None,
    top_k: int = 10,
    penalize_paths: bool = True,
    links: graph.Lookup | None = None,
    expand: bool = False,
    held: bm25.Index | None = None,
    keys: DataFrame | None = None,
    given: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """query_id, rank, chunk_ord, score and the chunk's columns.

    chunks: chunk_ord and CHUNK. vector_hits: query_id, rank, chunk_ord, at least max(10 * top_k, 100) a query. expand:
    whether some query asks for relations; links are the graph's. held and keys: the written index, if there is one.
    given: channels from elsewhere, instead of the lexical ones. Filters come after recall. Content is joined again for the
    candidates only, of which a query that asks for relations may have most chunks: their concepts are found by whole batches.
    What several joins read is written, so that it is made once and its size is known.
    """
    depth, queries = max(10 * top_k, RECALL), written(queries, "queries")
    if given is None:
        fields = bm25.search_fields(chunks, queries, depth, held=held)
        given = {f: fields.where(F.col("field") == f) for f in bm25.FIELDS}
    channels = given | {"symbol": symbol_channel(chunks, queries, depth, keys)}
    if vector_hits is not None:
        channels["vector"] = vector_hits.where(F.col("rank") <= depth)
    fused = written(fuse({c: channels[c] for c in CHANNELS if c in channels}, queries), "fused")  # a few hundred rows a query
    scored = written(expanded(fused, queries, chunks, links), "scored") if expand and links is not None else fused.select("query_id", "chunk_ord", "score")
    rows = scored.join(chunks, "chunk_ord").join(queries, "query_id")
    own = {c: F.col(c) for c in CHUNK_COLUMNS}
    asked = {c: F.col(c) for c in queries.columns}
    rows = rows.where(rank.passes_filters(own, asked))
    about = T.metadata_text(F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))
    rows = with_hits(rows, F.concat_ws("\n", about, "content"))
    factor = rank.relevance_factor({c: F.col(c) for c in ("file_path", "kind", "name", "language", "hits")}, asked)
    adjusted = F.when((F.col("score") <= 0) | (F.col("alpha") >= 1), F.col("score")).otherwise(F.greatest(F.col("score") * factor, F.lit(TINY)))
    penalty = paths.prior(F.col("file_path"), F.col("for_tests")) if penalize_paths else F.lit(1.0)
    narrow = written(rows.select("query_id", "chunk_ord", "file_path", "start_line", F.round(adjusted, 12).alias("score"), penalty.alias("penalty")), "adjusted")
    ranked = saturated(coherent(narrow).withColumn("score", F.col("score") * F.col("penalty")), top_k)
    return written(ranked.select("query_id", "rank", "chunk_ord", "score"), "ranked").join(chunks, "chunk_ord")
