"""BM25 over three fields of chunks: postings, lengths, scores, ranked and combined searches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.segments import segment, slices
from quarry.functions.terms import split_token, stems
from quarry.schema import FIELD_WEIGHTS, Bm25
from quarry.shared import written

FIELDS = tuple(FIELD_WEIGHTS)
#: Scores are rounded to so many digits before they are ranked, as sums come in any order.
DIGITS = 9
#: Terms of up to so many go to the workers, which leave out the postings of others.
FEW = 1 << 14


class Index(NamedTuple):
    """postings: field, term, chunk_ord, tf, dl. stats: field, n, avgdl. terms: field, term, df."""

    postings: DataFrame
    stats: DataFrame
    terms: DataFrame


def field_tokens(chunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field, chunk_ord, tokens: a chunk's document in each field. Content keeps repeated tokens, names and paths have each once with its stems."""
    tokens = {"content": T.tokens(F.col("content")), "name": T.name_tokens(F.col("name")), "path": T.path_tokens(F.col("file_path"))}
    return reduce(DataFrame.unionByName, (chunks.select(F.lit(f).alias("field"), "chunk_ord", tokens[f].alias("tokens")) for f in fields))


def field_stats(documents: DataFrame) -> DataFrame:
    """Empty documents count."""
    return documents.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def _stemmed(token: str) -> list[str]:
    return [x for part in split_token(token) for x in (part, *stems(part))]


def postings(chunks: DataFrame, fields: tuple[str, ...] = FIELDS, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """field, term, chunk_ord, tf, dl, of all terms or of the wanted ones by field; and a chunk's length in each field, as that of no term (null for a null content).

    Each part of a task's texts makes a segment of its own, sorted by field and term; nothing is shuffled.
    """
    texts = {"content": F.col("content"), "name": F.coalesce("name", F.lit("")), "path": T.path_text(F.col("file_path"))}
    kind = chunks.schema["chunk_ord"].dataType.simpleString()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, list[str]]] = {f: {} for f in fields}
        keep = None if wanted is None else {f: pa.array(wanted.get(f, []), pa.string()) for f in fields}
        for batch in given:
            for i, field in enumerate(fields):
                for at, to in slices(batch.column(i + 1)):
                    text, keys = batch.column(i + 1).slice(at, to - at), batch.column(0).slice(at, to - at)
                    words, number, word = segment(text, split_token if field == "content" else _stemmed, known[field])
                    many = len(text)
                    if field == "content":
                        size = np.bincount(number, minlength=many)
                        if keep is not None:
                            some = np.asarray(pc.is_in(words, keep[field]))[word]
                            number, word = number[some], word[some]
                        both, tf = np.unique(word * many + number, return_counts=True)
                    else:  # each term once
                        both = np.unique(word * many + number)
                        size = np.bincount(both % many, minlength=many)
                        if keep is not None:
                            both = both[np.asarray(pc.is_in(words, keep[field]))[both // many]]
                        tf = np.ones(len(both), np.int64)
                    number = both % many
                    sizes = pa.array(size, pa.int32(), mask=np.asarray(text.is_null()))
                    none = [pa.array([field] * many), pa.nulls(many, pa.string()), keys, pa.array(np.ones(many, np.int64)), sizes]
                    held = [pa.array([field]).take(pa.array(np.zeros(len(both), np.int64))), words.take(pa.array(both // many)), keys.take(pa.array(number)), pa.array(tf.astype(np.int64)), sizes.take(pa.array(number))]
                    for columns in (none, held):
                        yield pa.RecordBatch.from_arrays(columns, ["field", "term", "chunk_ord", "tf", "dl"])

    return chunks.select("chunk_ord", *(texts[f].alias(f) for f in fields)).mapInArrow(run, f"field string, term string, chunk_ord {kind}, tf long, dl int")


def index_of(rows: DataFrame, chunks: DataFrame) -> Index:
    """The index over written postings(). Chunks that share a number are one."""
    held, sizes = rows.where("term IS NOT NULL"), rows.where("term IS NULL")
    if chunks.groupBy("chunk_ord").count().where("count > 1").limit(1).count():
        held = held.groupBy("field", "term", "chunk_ord", "dl").agg(F.sum("tf").alias("tf")).select(rows.columns)
    stats = sizes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Index(held, stats, held.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")))


def index(chunks: DataFrame, terms: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> Index:
    """The whole index or, with terms (field, term), at least what these need. Texts are cut into tokens once: postings are written, and lengths with them."""
    wanted: dict[str, list[str]] | None = None
    if terms is not None:
        found = terms.select("field", "term").distinct().limit(FEW + 1).collect()
        if len(found) <= FEW:
            wanted = {f: [r["term"] for r in found if r["field"] == f] for f in fields}
    return index_of(written(postings(chunks, fields, wanted), "postings"), chunks)


def query_terms(queries: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """query_id, field, term: content terms leave out stop words, names and paths keep them."""
    of = {"content": "content_terms", "name": "metadata_terms", "path": "metadata_terms"}
    return reduce(DataFrame.unionByName, (queries.select("query_id", F.lit(f).alias("field"), F.explode(of[f]).alias("term")) for f in fields))


def weight(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, scorer: Bm25 = Bm25()) -> Column:
    """One term's part of a score."""
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    return idf * tf / (F.lit(scorer.k1) * (F.lit(1 - scorer.b) + F.lit(scorer.b) * dl / avgdl) + tf)


def scores(terms: DataFrame, held: Index, scorer: Bm25 = Bm25()) -> DataFrame:
    """query_id, field, chunk_ord, score, of chunks with a positive, finite score. The query's side is written before it meets the postings: which side is sent to all is left to its size, and a frame from the driver has none."""
    rows = held.postings.join(written(terms.join(held.terms, ["field", "term"]).join(held.stats, "field"), "asked_terms"), ["field", "term"])
    part = weight(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"), scorer)
    out = rows.groupBy("query_id", "field", "chunk_ord").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return out.where((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") < float("inf")))


def top(scored: DataFrame, k: int, by: list[str], tie: list[str]) -> DataFrame:
    """The k rows of each group with the highest score, and their `rank` from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), *tie))).where(F.col("rank") <= k)


def search_fields(chunks: DataFrame, queries: DataFrame, k: int, fields: tuple[str, ...] = FIELDS, held: Index | None = None) -> DataFrame:
    """query_id, field, rank, chunk_ord, score: each field's k best chunks; ties go to the earlier chunk."""
    terms = query_terms(queries, fields)
    return top(scores(terms, held or index(chunks, terms, fields)), k, ["query_id", "field"], ["chunk_ord"])


def search_combined(chunks: DataFrame, queries: DataFrame, k: int, held: Index | None = None) -> DataFrame:
    """query_id, rank, chunk_ord, score: the fields' scores, each over its greatest, weighed and added; ties go to the field that comes first, then the chunk."""
    terms = query_terms(queries)
    found = written(scores(terms, held or index(chunks, terms)), "scores")
    by_field = lambda values: reduce(lambda a, b: a.when(F.col("field") == b[0], b[1]), values.items(), F)
    most = found.groupBy("query_id", "field").agg(F.max("score").alias("most"))  # a row for each query and field
    parts = found.join(most, ["query_id", "field"]).select("query_id", "chunk_ord", (by_field(FIELD_WEIGHTS) * F.col("score") / F.col("most")).alias("part"), by_field({f: i for i, f in enumerate(FIELDS)}).alias("first"))
    summed = parts.groupBy("query_id", "chunk_ord").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.min("first").alias("first"))
    return top(summed, k, ["query_id"], ["first", "chunk_ord"]).select("query_id", "rank", "chunk_ord", "score")
