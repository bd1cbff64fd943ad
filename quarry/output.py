"""Results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import location
from quarry.schema import CHUNK_COLUMNS


def as_json(found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, json: {"query", "results": [{"score", "chunk"}]}, results by rank; a query without results has none. found: query_id, rank, score and the chunk's columns."""
    chunk = F.struct(*CHUNK_COLUMNS, location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("location"))
    results = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", chunk.alias("chunk")))).alias("r"))
    rows = queries.select("query_id", "raw").join(results, "query_id", "left")
    listed = F.transform(F.coalesce("r", F.array()), lambda x: F.struct(x["score"].alias("score"), x["chunk"].alias("chunk")))
    return rows.select("query_id", F.to_json(F.struct(F.col("raw").alias("query"), listed.alias("results")), {"ignoreNullFields": "false"}).alias("json"))
