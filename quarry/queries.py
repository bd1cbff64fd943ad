"""The engine's queries over the test tables, and their SQL.

The tables hold no source code, so documents stand as chunks: chunks_of() gives them paths, kinds, names and an import.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sql as S
from quarry.functions import paths, rank
from quarry.functions import text as T
from quarry.functions.terms import ALIASES, STOP_WORDS
from quarry.operators import bm25, graph, vectors
from quarry.plans import hybrid
from quarry.reach import reach
from quarry.schema import CHUNK
from quarry.shared import cleared, shared_dir, spread, written
from quarry.sources import chunker, tree

#: A question that asks for relations, a symbol, one with filters, one with an identifier.
QUERIES = ["where is the core import of src3 handled", "AnatWith", "kind:function,method lang:en path:src reading the core tests", "how does ou_et error reading work"]
PLAIN_QUERIES = ["reading the core message of src1 tests", "AnatWith"]
DEPTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(documents: DataFrame) -> DataFrame:
    """chunk_ord and CHUNK."""
    i, s, text = F.col("doc_id"), F.col("source"), F.col("text")
    number = i.cast("string")
    path = [F.concat(F.lit("src/"), s, F.lit("/core.py")), F.concat(F.lit("tests/test_"), number, F.lit(".py")), F.concat(F.lit("src/_doc_"), number, F.lit(".py")), F.concat(F.lit("examples/"), s, F.lit("/doc_"), number, F.lit(".js")),
            F.concat(F.lit("src/"), s, F.lit("/__init__.py")), F.concat(F.lit("api/doc_"), number, F.lit(".pb.go")), F.concat(F.lit("types/doc_"), number, F.lit(".d.ts")), F.concat(F.lit("src/jvmTest/Doc"), number, F.lit("Test.kt")), F.concat(F.lit("lib/"), s, F.lit("/doc_"), number, F.lit(".py"))]
    words = F.filter(F.array(F.regexp_extract(text, "^[^A-Za-z]*+([A-Za-z]+)", 1), F.regexp_extract(text, "^[^A-Za-z]*+[A-Za-z]++[^A-Za-z]++([A-Za-z]+)", 1)), lambda w: w != "")
    camel = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return documents.select(
        i.alias("chunk_ord"),
        F.concat(F.lit("import "), s, F.lit(".doc_"), ((i * 7) % 200).cast("string"), F.lit("\n"), text).alias("content"),
        F.element_at(F.array(*path), (i % 9 + 1).cast("int")).alias("file_path"),
        (i + 1).cast("int").alias("start_line"),
        (i + 2 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int").alias("end_line"),
        F.element_at(F.array(*map(F.lit, ("function", "method", "class", "module", "file"))), (i % 5 + 1).cast("int")).alias("kind"),
        F.when(i % 5 < 3, F.when(i % 2 == 0, camel).otherwise(F.array_join(words, "_"))).alias("name"),
        F.col("lang").alias("language"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


class SearchIndex(NamedTuple):
    """What searches over the documents read: chunks, BM25 frames, keys of names, and the graph's lookups."""

    chunks: DataFrame
    held: bm25.Index
    keys: DataFrame
    links: graph.Lookup


_INDEXES: dict[tuple, SearchIndex] = {}


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of the documents, written to the shared folder when it is first needed, and again when the application or the table's files are others.

    Postings lie by field and sorted by term, so a query's terms skip most of them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in [files.getFileStatus(path), *files.listStatus(path)]))
    if (key := (spark.sparkContext.applicationId, cleared(), state)) not in _INDEXES:
        rows = written(chunks(spark, sf_dir), "chunks")
        held = bm25.index(rows)
        postings = written(held.postings.repartitionByRange("field", "term", "chunk_ord").sortWithinPartitions("field", "term"), "postings", ["field"]).select(held.postings.columns)
        held = bm25.Index(postings, written(held.stats, "stats"), written(held.terms, "terms"))
        links = graph.lookup(rows)
        _INDEXES[key] = SearchIndex(rows, held, written(hybrid.name_keys(rows), "names"), graph.Lookup(*(written(x, "links") for x in links)))
    return _INDEXES[key]


Query = Callable[[SparkSession, str], DataFrame]
QUERY_FUNCTIONS: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERY_FUNCTIONS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sorted_text(c: Column) -> Column:
    return F.array_join(F.array_sort(c), " ")


def columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def asked(spark: SparkSession, given: list[str] = QUERIES, alpha: float | None = None) -> DataFrame:
    return hybrid.query_frame(spark, given, alpha)


@query(S.with_(S.CHUNKS) + "SELECT chunk_ord, md5(content) AS content_md5, file_path, start_line, end_line, kind, name, language FROM chunks")
def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", F.md5("content").alias("content_md5"), "file_path", "start_line", "end_line", "kind", "name", "language")


@query(S.with_(S.CHUNKS) + "SELECT chunk_ord, file_path || ':' || start_line || '-' || end_line AS location FROM chunks")
def location_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", T.location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("location"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('html')}) AS token FROM pages) GROUP BY token")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers are counted before they are split, so each different one is split once a task."""
    raw = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), 0)).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return raw.select(F.explode(T.split_token(F.col("raw"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


@query(S.with_(S.CHUNKS, S.DOCS) + "SELECT field, term, df FROM terms")
def term_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.index(chunks(spark, sf_dir)).terms


@query(S.with_(S.CHUNKS, S.DOCS) + "SELECT field, n, round(avgdl, 6) AS avgdl FROM stats")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.field_stats(bm25.field_tokens(chunks(spark, sf_dir))).select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT term, {S.joined(S.stems('term'))} AS stems FROM (SELECT DISTINCT unnest({S.tokens('text')}) AS term FROM conversations)")
def stem_variants_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", sorted_text(T.stem_variants(F.col("term"))).alias("stems"))


@query(f"WITH aliases(term, alias) AS (VALUES {S.ALIAS_ROWS}) SELECT item_id, t.term, alias FROM (SELECT DISTINCT item_id, unnest({S.tokens('text')} || ['config', 'fn', 'tests']) AS term FROM benchmark) t JOIN aliases USING (term)")
def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([(k, v) for k, vs in ALIASES.items() for v in vs], "term string, alias string")
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.concat(T.tokens(F.col("text")), F.array(*map(F.lit, ("config", "fn", "tests"))))).alias("term")).distinct()
    return terms.join(aliases, "term").select("item_id", "term", "alias")


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS token FROM benchmark) WHERE token NOT IN ({S.STOP_ROWS}) AND length(token) > 2 GROUP BY token")
def stop_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.where(~F.col("token").isin(*STOP_WORDS) & (F.length("token") > 2)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_(S.CHUNKS) + f"SELECT chunk_ord, {S.joined(S.path_tokens('file_path'))} AS tokens FROM chunks")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", sorted_text(T.path_tokens(F.col("file_path"))).alias("tokens"))


_NAME_TOKENS = S.with_stems(S.tokens("coalesce(name, '')"))


@query(S.with_(S.CHUNKS) + f"SELECT chunk_ord, {S.joined(_NAME_TOKENS)} AS tokens FROM chunks")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", sorted_text(T.name_tokens(F.col("name"))).alias("tokens"))


_STEM, _DIRS = S.stem(S.file_name("file_path")), S.dirs("file_path")
_ENRICHED = f"content || ' ' || {_STEM} || ' ' || {_STEM} || ' ' || array_to_string({_DIRS}[-3:], ' ') || ' ' || concat_ws(' ', nullif(kind, ''), nullif(name, ''), nullif(language, ''))"


@query(S.with_(S.CHUNKS) + f"SELECT chunk_ord, md5({_ENRICHED}) AS enriched_md5 FROM chunks")
def enrich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", F.md5(T.enriched(F.col("content"), F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))).alias("enriched_md5"))


@query(S.with_(S.CHUNKS) + "SELECT chunk_ord, md5(concat_ws(chr(10), 'path: ' || file_path, 'kind: ' || kind, 'name: ' || nullif(name, ''), 'language: ' || nullif(language, ''), '', content)) AS text_md5 FROM chunks")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", F.md5(T.embedding_text(F.col("content"), F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))).alias("text_md5"))


def _field(field: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = search_index(spark, sf_dir)
        return bm25.search_fields(index.chunks, asked(spark), DEPTH, (field,), index.held).select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))

    run.__name__ = f"bm25_{field}"
    query(S.with_(S.CHUNKS, S.DOCS, S.queries_cte(QUERIES), S.QUERY_TERMS, S.SCORES, S.ranked(DEPTH)) + f"SELECT query_id, CAST(rank AS INT) AS rank, chunk_ord, round(score, 6) AS score FROM field_hits WHERE field = '{field}'")(run)


for _name in bm25.FIELDS:
    _field(_name)


@query(
    S.with_(S.CHUNKS, S.DOCS, S.queries_cte(QUERIES), S.QUERY_TERMS, S.SCORES)
    + f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_ord) AS INT) AS rank, chunk_ord, round(score, 6) AS score FROM (
  SELECT query_id, chunk_ord, round(sum(part), 9) AS score, min(first) AS first FROM (
    SELECT query_id, chunk_ord, CASE field WHEN 'content' THEN 1.0::DOUBLE WHEN 'name' THEN 6.0::DOUBLE ELSE 3.0::DOUBLE END * score / max(score) OVER (PARTITION BY query_id, field) AS part, CASE field WHEN 'content' THEN 0 WHEN 'name' THEN 1 ELSE 2 END AS first FROM scores)
  GROUP BY query_id, chunk_ord) QUALIFY rank <= {DEPTH}"""
)
def bm25_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search_index(spark, sf_dir)
    return bm25.search_combined(index.chunks, asked(spark), DEPTH, index.held).select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))


_FLAGS = S.prior("file_path", "FALSE")


@query(S.with_(S.CHUNKS) + f"SELECT chunk_ord, {S.is_test_file('file_path')} AS is_test, {S.is_generated_file('file_path')} AS is_generated, round({_FLAGS}, 6) AS prior FROM chunks")
def path_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return chunks(spark, sf_dir).select("chunk_ord", paths.is_test_file(p).alias("is_test"), paths.is_generated_file(p).alias("is_generated"), F.round(paths.prior(p, F.lit(False)), 6).alias("prior"))


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of four queries against all chunks."""
    return chunks(spark, sf_dir).crossJoin(asked(spark))


@query(S.with_(S.CHUNKS, S.queries_cte(QUERIES)) + f"SELECT query_id, chunk_ord, round({S.name_bonus()}, 6) AS name_bonus, round({S.path_bonus()}, 6) AS path_bonus, round({S.kind_bonus()}, 6) AS kind_bonus FROM chunks, queries")
def bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = columns(rows := _crossed(spark, sf_dir))
    name = rank.name_bonus(c["name"], c["search_text"], c["compact"], c["word_compacts"], c["raw_terms"])
    return rows.select("query_id", "chunk_ord", F.round(name, 6).alias("name_bonus"), F.round(rank.path_bonus(c["file_path"], c["base_terms"]), 6).alias("path_bonus"), F.round(rank.kind_bonus(c["kind"]), 6).alias("kind_bonus"))


@query(S.with_(S.CHUNKS, S.queries_cte(QUERIES), "candidates AS (SELECT * FROM chunks, queries)", S.FACTORS) + "SELECT query_id, chunk_ord, round(factor, 6) AS factor FROM factors")
def relevance_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's tokens are found once, before it meets the queries."""
    rows = chunks(spark, sf_dir).withColumn("content_tokens", F.array_distinct(T.tokens(F.col("content")))).drop("content")
    c = columns(rows := rows.crossJoin(asked(spark)))
    return rows.select("query_id", "chunk_ord", F.round(rank.relevance_factor(c, c), 6).alias("factor"))


@query(S.with_(S.CHUNKS, S.queries_cte(QUERIES), "candidates AS (SELECT * FROM chunks, queries)", S.FACTORS) + "SELECT query_id, chunk_ord, CAST(hits AS INT) AS hits FROM factors")
def concept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = T.metadata_tokens(F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))
    rows = chunks(spark, sf_dir).select("chunk_ord", metadata.alias("m"), F.array_distinct(T.tokens(F.col("content"))).alias("t")).crossJoin(asked(spark).select("query_id", "groups"))
    return rows.select("query_id", "chunk_ord", rank.concept_hits(F.col("groups"), F.col("m"), F.col("t")).alias("hits"))


@query(S.with_(S.CHUNKS, S.queries_cte(QUERIES)) + f"SELECT query_id, chunk_ord, md5({S.FIRST_LINE}) AS line_md5, round(least(0.8::DOUBLE, 0.2::DOUBLE * len(list_filter(raw_terms, lambda q: contains({S.FIRST_LINE}, q)))), 6) AS bonus FROM chunks, queries")
def definition_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = columns(rows := _crossed(spark, sf_dir))
    return rows.select("query_id", "chunk_ord", F.md5(rank.first_line(c["content"])).alias("line_md5"), F.round(rank.definition_bonus(c["content"], c["raw_terms"]), 6).alias("bonus"))


@query(S.with_(S.CHUNKS, S.queries_cte(QUERIES)) + f"SELECT query_id, chunk_ord FROM chunks, queries WHERE {S.FILTERS}")
def query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = columns(rows := _crossed(spark, sf_dir))
    return rows.where(rank.passes_filters(c, c)).select("query_id", "chunk_ord")


@query(S.with_(S.CHUNKS, S.queries_cte(QUERIES), S.SYMBOLS, S.symbol_hits(DEPTH)) + "SELECT query_id, CAST(rank AS INT) AS rank, chunk_ord, round(score, 6) AS score FROM symbol_hits")
def symbol_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.symbol_channel(chunks(spark, sf_dir), asked(spark), DEPTH).withColumn("score", F.round("score", 6))


_UNIT = "SELECT vec_id, list_transform(v, lambda x: round(x / n, 6)) AS unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12::DOUBLE) AS n FROM embeddings)"


@query(f"SELECT vec_id, round(list_sum(list_transform(unit, lambda x: x * x)), 4) AS squares, unit[1] AS first_component FROM ({_UNIT})")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(vectors.normalized(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))
    return unit.select("vec_id", F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squares"), F.col("unit")[0].alias("first_component"))


def _vectors(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_ord"), "embedding")
    return rows, [(r["chunk_ord"], r["embedding"]) for r in rows.where(F.col("chunk_ord") < n).collect()]


@query(S.with_(S.queries_cte(QUERIES), S.vector_hits(DEPTH)) + "SELECT query_id, CAST(rank AS INT) AS rank, chunk_ord, round(score, 6) AS score FROM vector_hits")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, given = _vectors(spark, sf_dir, len(QUERIES))
    return vectors.cosine_top(rows, given, DEPTH).withColumn("score", F.round("score", 6))


@query(S.with_(S.vector_hits(10).split(",\nvector_hits")[0]) + "SELECT * FROM (SELECT label AS query_id, CAST(row_number() OVER (PARTITION BY label ORDER BY round(list_inner_product(q, u), 9) DESC, vec_id) AS INT) AS rank, vec_id AS chunk_ord, round(list_inner_product(q, u), 6) AS score FROM (SELECT CAST(label AS BIGINT) AS label, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12::DOUBLE)) AS q FROM (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS a FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)), unit) WHERE rank <= 10")
def cosine_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean vector as a query. Labels are few: their means are the stated queries."""
    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("a"))
    given = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("m")).select("label", F.transform("m", lambda x: x["a"]).alias("m")).collect()
    return vectors.cosine_top(rows.select(F.col("vec_id").alias("chunk_ord"), "embedding"), [(int(r["label"]), r["m"]) for r in given], 10).withColumn("score", F.round("score", 6))


def _search(name: str, given: list[str], expand: bool, alpha: float | None = None, penalize: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Stated queries: the chunks' postings of these terms, and what the graph says of these seeds, not a whole index."""
        rows = written(chunks(spark, sf_dir), "chunks")
        held, of = _vectors(spark, sf_dir, len(given))
        hits = vectors.cosine_top(held, of, DEPTH)
        links = graph.lookup(rows) if expand else None
        return hybrid.search(rows, asked(spark, given, alpha), hits, 10, penalize, links, expand).select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))

    run.__name__ = name
    query(_search_sql(given, expand, alpha, penalize))(run)


def _search_sql(given: list[str], expand: bool, alpha: float | None = None, penalize: bool = True) -> str:
    tail = [S.IDENTIFIERS, S.IMPORTS, S.MODULES, S.RESOLVED, S.LOOKUP, S.EXPANDED] if expand else ["scored AS (SELECT query_id, chunk_ord, score FROM fused)"]
    ctes = S.with_(S.CHUNKS, S.DOCS, S.queries_cte(given, alpha), S.QUERY_TERMS, S.SCORES, S.ranked(DEPTH), S.SYMBOLS, S.symbol_hits(DEPTH), S.vector_hits(DEPTH), S.FUSED, *tail, S.reranked(10, penalize))
    return ctes + "SELECT query_id, CAST(rank AS INT) AS rank, chunk_ord, round(score, 6) AS score FROM final"


_search("hybrid_search", QUERIES, True)
_search("hybrid_alpha_0", PLAIN_QUERIES, False, 0.0)
_search("hybrid_alpha_1", PLAIN_QUERIES, False, 1.0)
_search("hybrid_no_path_penalty", PLAIN_QUERIES, False, None, False)


@query(S.with_(S.CHUNKS, S.DOCS, S.queries_cte(QUERIES), S.QUERY_TERMS, S.SCORES, S.ranked(DEPTH), S.SYMBOLS, S.symbol_hits(DEPTH), S.vector_hits(DEPTH), S.FUSED) + "SELECT query_id, chunk_ord, round(score, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = search_index(spark, sf_dir), asked(spark)
    fields = bm25.search_fields(index.chunks, queries, DEPTH, held=index.held)
    held, of = _vectors(spark, sf_dir, len(QUERIES))
    channels = {f: fields.where(F.col("field") == f) for f in bm25.FIELDS} | {"vector": vectors.cosine_top(held, of, DEPTH), "symbol": hybrid.symbol_channel(index.chunks, queries, DEPTH, index.keys)}
    return hybrid.fuse({c: channels[c] for c in hybrid.CHANNELS}, queries).select("query_id", "chunk_ord", F.round("score", 9).alias("score"))


_SCORED = "scored_ AS (SELECT 0::BIGINT AS query_id, chunk_ord, file_path, start_line, round(1.0::DOUBLE / (1 + (chunk_ord * 37) % 101), 12) AS score FROM chunks)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select(F.lit(0).cast("long").alias("query_id"), "chunk_ord", "file_path", "start_line", F.round(1.0 / (1 + (F.col("chunk_ord") * 37) % 101), 12).alias("score"))


@query(
    S.with_(S.CHUNKS, _SCORED)
    + """SELECT chunk_ord, round(score + CASE WHEN best = 1 THEN most * 0.15::DOUBLE * total / max(total) OVER () ELSE 0::DOUBLE END, 9) AS score FROM (
  SELECT *, round(sum(score) OVER (PARTITION BY file_path), 12) AS total, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, start_line) AS best, max(score) OVER () AS most FROM scored_)"""
)
def file_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.coherent(_scored(spark, sf_dir)).select("chunk_ord", F.round("score", 9).alias("score"))


@query(
    S.with_(S.CHUNKS, _SCORED)
    + """SELECT chunk_ord, CAST(row_number() OVER (ORDER BY now DESC, score DESC, file_path, start_line) AS INT) AS rank, round(now, 6) AS score FROM (
  SELECT *, round(score * pow(0.65::DOUBLE, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, start_line) - 1), 9) AS now FROM (SELECT * REPLACE (round(score, 9) AS score) FROM scored_)) QUALIFY rank <= 50"""
)
def file_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.saturated(_scored(spark, sf_dir), 50).select("chunk_ord", "rank", F.round("score", 6).alias("score"))


@query(S.with_(S.CHUNKS, S.IDENTIFIERS) + "SELECT chunk_ord, x AS identifier FROM identifiers")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_ord", F.explode(graph.identifiers(F.col("content"))).alias("identifier"))


@query(S.with_(S.CHUNKS, S.IMPORTS) + "SELECT file_path, module FROM imports")
def import_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.imports(chunks(spark, sf_dir))


@query(S.with_(S.CHUNKS, S.MODULES) + "SELECT file_path, module FROM module_names")
def module_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("file_path").distinct().select("file_path", F.explode(graph.module_names(F.col("file_path"))).alias("module"))


@query(S.with_(S.CHUNKS, S.MODULES) + "SELECT module, file FROM unique_modules")
def unique_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unique_modules(chunks(spark, sf_dir).select("file_path").distinct())


@query(S.with_(S.CHUNKS, S.IMPORTS, S.MODULES, S.RESOLVED) + "SELECT file_path, module, target FROM resolved")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return graph.resolved_imports(graph.imports(rows), rows.select("file_path").distinct())


@query(S.with_(S.CHUNKS, S.IDENTIFIERS, S.IMPORTS, S.MODULES, S.NODES) + "SELECT id, kind, label, file_path, chunk_id, language FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(chunks(spark, sf_dir))


@query(S.with_(S.CHUNKS, S.IDENTIFIERS, S.IMPORTS, S.MODULES, S.RESOLVED, S.EDGES) + "SELECT source_id, target_id, kind, confidence FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(chunks(spark, sf_dir))


@query(S.with_(S.CHUNKS, S.IDENTIFIERS, S.IMPORTS, S.MODULES, S.RESOLVED, S.LOOKUP) + "SELECT 'neighbour' AS what, file AS key, other AS value FROM neighbours UNION ALL SELECT 'definition', term, CAST(chunk_ord AS VARCHAR) FROM definitions UNION ALL SELECT 'reference', term, CAST(chunk_ord AS VARCHAR) FROM refs")
def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    of = lambda df, what: df.select(F.lit(what).alias("what"), F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).cast("string").alias("value"))
    return of(graph.neighbours(graph.edges(rows)), "neighbour").unionByName(of(graph.definitions(rows), "definition")).unionByName(of(graph.references(rows), "reference"))


@query(
    S.with_(S.CHUNKS, S.DOCS, S.queries_cte(QUERIES), S.QUERY_TERMS, S.SCORES, S.ranked(DEPTH), S.SYMBOLS, S.symbol_hits(DEPTH), S.vector_hits(DEPTH), S.FUSED, S.IDENTIFIERS, S.IMPORTS, S.MODULES, S.RESOLVED, S.LOOKUP, S.EXPANDED)
    + "SELECT query_id, chunk_ord, round(score, 9) AS score FROM scored"
)
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = search_index(spark, sf_dir), asked(spark)
    fields = bm25.search_fields(index.chunks, queries, DEPTH, held=index.held)
    held, of = _vectors(spark, sf_dir, len(QUERIES))
    channels = {f: fields.where(F.col("field") == f) for f in bm25.FIELDS} | {"vector": vectors.cosine_top(held, of, DEPTH), "symbol": hybrid.symbol_channel(index.chunks, queries, DEPTH, index.keys)}
    fused = written(hybrid.fuse({c: channels[c] for c in hybrid.CHANNELS}, queries), "fused")
    out = hybrid.expanded(fused, queries, index.chunks, index.links)
    return out.select("query_id", "chunk_ord", F.round("score", 9).alias("score"))


@query(S.with_(S.CHUNKS, S.IDENTIFIERS, S.IMPORTS, S.MODULES, S.RESOLVED, S.NODES, S.EDGES) + "SELECT (SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(*) FROM nodes) AS graph_node_count, (SELECT count(*) FROM edges) AS graph_edge_count")
def index_metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(rows, "chunk_count").crossJoin(count(graph.nodes(rows), "graph_node_count")).crossJoin(count(graph.edges(rows), "graph_edge_count"))


@query(f"SELECT page_id, {S.joined(S.path_tokens('url'))} AS tokens FROM pages")
def pages_url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sorted_text(T.path_tokens(F.col("url"))).alias("tokens"))


@query(f"SELECT role, token, count(*) AS n FROM (SELECT role, unnest({S.tokens('text')}) AS token FROM conversations) GROUP BY role, token")
def conversations_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("role", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("role", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    S.with_(S.CHUNKS, S.DOCS, f"query_terms AS (SELECT DISTINCT item_id AS query_id, 'content' AS field, term FROM (SELECT item_id, unnest({S.tokens('text')}) AS term FROM benchmark) WHERE length(term) > 2 AND term NOT IN ({S.STOP_ROWS}))", S.SCORES, S.ranked(10))
    + "SELECT query_id, CAST(rank AS INT) AS rank, chunk_ord, round(score, 6) AS score FROM field_hits"
)
def benchmark_batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as content queries, without stems and aliases."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("content").alias("field"), F.explode(T.tokens(F.col("text"))).alias("term"))
    terms = items.where((F.length("term") > 2) & ~F.col("term").isin(*STOP_WORDS)).distinct()
    found = bm25.scores(terms, search_index(spark, sf_dir).held)
    return bm25.top(found, 10, ["query_id"], ["chunk_ord"]).select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))


#: Stated queries of each class, beside the benchmark's.
CLASSES = ["Command", "app.Session", "fix parse_options now", "HTTPServer errors", "how are sessions kept", "where are callers of verify", "session storage", "imports of tests kind:function", "lang:en,fr kind: path:src,lib x", "name:run"]
_ASKED = "SELECT item_id AS query_id, text AS raw FROM benchmark UNION ALL " + " UNION ALL ".join(f"SELECT {-i - 1}, {S.quote(q)}" for i, q in enumerate(CLASSES))


def _asked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items and CLASSES as queries, parsed by the workers."""
    stated = spark.createDataFrame([(-i - 1, q) for i, q in enumerate(CLASSES)], "item_id long, text string")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return hybrid.parse_batch(items.unionByName(stated), "item_id", "text")


@query(S.with_(S.parsed_cte(_ASKED)) + "SELECT query_id, alpha, w_content, w_vector, w_name, w_path, w_symbol, expand, for_tests FROM parsed")
def channel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked_all(spark, sf_dir).select("query_id", "alpha", "w_content", "w_vector", "w_name", "w_path", "w_symbol", "expand", "for_tests")


_LISTS = ("word_compacts", "raw_terms", "base_terms", "content_terms", "metadata_terms", "kinds", "languages", "paths", "names")


@query(S.with_(S.parsed_cte(_ASKED)) + "SELECT query_id, raw, search_text, compact, " + ", ".join(f"{S.joined(x)} AS {x}" for x in _LISTS) + " FROM parsed")
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked_all(spark, sf_dir).select("query_id", "raw", "search_text", "compact", *(sorted_text(F.col(x)).alias(x) for x in _LISTS))


@query(S.with_(S.parsed_cte(_ASKED), S.QUERY_TERMS.replace("FROM queries", "FROM parsed")) + "SELECT query_id, field, term FROM query_terms")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of all queries, by field."""
    return bm25.query_terms(_asked_all(spark, sf_dir))


#: Sources in languages of each sort, as (suffix, language, comment, pieces); a piece is (kind, name, text), of the kind None if it is blank. `%` stands for the document's id.
SOURCES = [
    ("py", "python", "# ", [
        ("module", None, "import store.doc_%\n\n"), ("function", "load_%", "@traced\n@cached(size=2)\ndef load_%(path):\n    def inner():\n        return '{'\n\n    return inner"), (None, None, "\n\n\n"),
        ("class", "Doc%", "class Doc%(Base):\n    size = %\n\n"), ("method", "Doc%.words", "    @property\n    async def words(self):\n        return self.size"), (None, None, "\n\n    "), ("class", "Part", "class Part:\n"), ("method", "Doc%.Part.first", "        def first(self):\n            return 1")]),
    ("ts", "typescript", "// ", [
        ("module", None, "import { a } from './doc_%';\n// not { a block\n"), ("function", "load_%", "export async function load_%(x) {\n  return '}' + x;\n}"), (None, None, "\n\n"),
        ("class", "Doc%", "class Doc% {\n"), ("method", "Doc%.words", "  words(x) {\n    if (x) { return 1; }\n    return this.size;\n  }"), ("module", None, "\n}\n"), ("function", "go_%", "const go_% = (y) => {\n  return y;\n}")]),
    ("kt", "kotlin", "// ", [("module", None, "package docs\n\n"), ("function", "load_%", "private fun load_%(x: Int): Int {\n    return x /* } */\n}"), (None, None, "\n"), ("class", "Doc%", "data class Doc%(val x: Int) {\n    val y = 2\n}")]),
    ("go", "go", "// ", [("module", None, "package docs\n\n"), ("function", "Load%", "func (d *Doc) Load%(x int) int {\n\treturn x\n}")]),
    ("txtless", None, "// ", []),
    ("rb", "ruby", "# ", []),
]


def _chunk_sql() -> str:
    """The pieces are the chunks: what a source is put together from is what it has to fall into."""
    rows = []
    for suffix, language, mark, given in SOURCES:
        line, nth = 0, 0
        text = f"replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x09\\x0B-\\x1F]', ' ', 'g'), chr(10), chr(10) || '{mark}')"
        path = f"'src/doc_' || doc_id || '.{suffix}'"
        put = lambda x: "replace(replace(" + S.quote(x.replace("\n", "~")) + ", '~', chr(10)), '%', CAST(doc_id AS VARCHAR))"
        where = f"FROM documents WHERE doc_id % {len(SOURCES)} = {len(rows)}"
        of = []
        for kind, name, piece in given:
            size = piece.count("\n")
            if kind:
                last = line + size + (not piece.endswith("\n"))
                of.append(f"SELECT doc_id AS file_ord, {nth} AS nth, {put(piece)} AS content, {path} AS file_path, {line + 1} AS start_line, {last} AS end_line, '{kind}' AS kind, {put(name) if name else 'NULL'} AS name, '{language}' AS language {where}")
                nth += 1
            line += size
        head = "chr(10)" if given else "''"
        rest = f"({head} || '{mark}' || {text})"
        if language:
            of.append(f"SELECT doc_id, {nth}, {rest}, {path}, {line + 1}, {line + 1} + length({rest}) - length(replace({rest}, chr(10), '')) - CASE WHEN suffix({rest}, chr(10)) THEN 1 ELSE 0 END, '{'module' if given else 'file'}', NULL, '{language}' {where}")
        rows.append(of)
    return "SELECT CAST(file_ord AS BIGINT) AS file_ord, CAST(nth AS BIGINT) AS nth, content, file_path, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, kind, name, language FROM (" + " UNION ALL ".join(x for of in rows for x in of) + ")"


@query(_chunk_sql())
def chunk_source_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each sort of language, made of SOURCES with the documents' texts as comments; one suffix is unknown, one language has no structure here."""
    number = F.col("doc_id").cast("string")
    content, path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (suffix, _, mark, given) in enumerate(SOURCES):
        mine = F.col("doc_id") % len(SOURCES) == n
        plain = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x09\x0B-\x1F]", " "), F.lit("\n"), F.lit("\n" + mark))
        head = F.replace(F.lit("".join(x for *_, x in given) + ("\n" if given else "")), F.lit("%"), number)
        content = F.when(mine, F.concat(head, F.lit(mark), plain)).otherwise(content)
        path = F.when(mine, F.concat(F.lit("src/doc_"), number, F.lit("." + suffix))).otherwise(path)
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunker.chunk_files(rows.select(F.col("doc_id").alias("file_ord"), content.alias("content"), path.alias("file_path")))


@query(_search_sql(QUERIES, True))
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' index, saved to the shared folder and loaded from there, with searches over what was loaded."""
    import uuid

    from quarry.store import HybridIndex

    rows, to = written(chunks(spark, sf_dir), "chunks"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    held, of = _vectors(spark, sf_dir, len(QUERIES))
    HybridIndex(rows, held, vectors.HashingModel()).save_to(to)
    index = HybridIndex.load_from(spark, to)
    hits = vectors.cosine_top(index.embeddings, of, DEPTH)
    return hybrid.search(index.chunks, asked(spark), hits, 10, True, index.links, True, index.held).select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))


_TRIES = ", ".join(f"({i}, {S.quote(x)})" for i, x in enumerate(["", *(m + s for m in ("", "/index", "/__init__") for s in sorted(S.SUFFIXES))]))


@query(
    S.with_(S.CHUNKS, f"tries(nth, ending) AS (VALUES {_TRIES})", "files AS (SELECT DISTINCT file_path FROM chunks)", "importing AS (SELECT file_path, './doc_' || regexp_extract(file_path, 'doc_(\\d+)', 1) AS module FROM files)")
    + "SELECT i.file_path, i.module, arg_min(f.file_path, nth) AS target FROM importing i, tries JOIN files f ON f.file_path = regexp_replace(i.file_path, '[^/]*$', '') || substr(i.module, 3) || ending GROUP BY ALL"
)
def relative_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file imports a neighbour by a relative name without a suffix."""
    rows = chunks(spark, sf_dir)
    found = rows.select("file_path", F.concat(F.lit("./doc_"), F.regexp_extract("file_path", r"doc_(\d+)", 1)).alias("module"))
    return graph.resolved_imports(found.distinct(), rows.select("file_path").distinct())


@query(
    S.with_(S.CHUNKS, S.DOCS, S.queries_cte(PLAIN_QUERIES), S.QUERY_TERMS, S.SCORES, S.ranked(DEPTH), S.SYMBOLS, S.symbol_hits(DEPTH), S.vector_hits(DEPTH), S.FUSED, "scored AS (SELECT query_id, chunk_ord, score FROM fused)", S.reranked(5, True))
    + "SELECT raw AS query, CAST(rank AS INT) AS rank, md5(content) AS content_md5, file_path, start_line, end_line, kind, name, language, file_path || ':' || start_line || '-' || end_line AS location, round(score, 6) AS score FROM final JOIN chunks USING (chunk_ord) JOIN queries USING (query_id)"
)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON, and read again from it."""
    from quarry.output import as_json

    index = search_index(spark, sf_dir)
    held, of = _vectors(spark, sf_dir, len(PLAIN_QUERIES))
    found = hybrid.search(index.chunks, asked(spark, PLAIN_QUERIES), vectors.cosine_top(held, of, DEPTH), 5, held=index.held, keys=index.keys)
    shape = f"query string, results array<struct<score: double, chunk: struct<{CHUNK.replace(' ', ': ').replace(',:', ',')}, location: string>>>"
    rows = as_json(found, asked(spark, PLAIN_QUERIES)).select(F.from_json("json", shape).alias("j")).select("j.query", F.posexplode("j.results").alias("at", "r"))
    parts = [F.col(f"r.chunk.{c}") for c in ("file_path", "start_line", "end_line", "kind", "name", "language", "location")]
    return rows.select("query", (F.col("at") + 1).alias("rank"), F.md5("r.chunk.content").alias("content_md5"), *parts, F.round("r.score", 6).alias("score"))


_EMBEDDED = "concat_ws(chr(10), 'path: ' || file_path, 'kind: ' || kind, 'name: ' || nullif(name, ''), 'language: ' || nullif(language, ''), '', content)"


@query(
    S.with_(S.CHUNKS, f"hashed AS (SELECT chunk_ord, md5(unnest({S.tokens(_EMBEDDED)})) AS h FROM chunks)", "cells AS (SELECT chunk_ord, CAST('0x' || h[1:2] AS INT) AS i, sum(CASE WHEN CAST('0x' || h[15:16] AS INT) > 127 THEN -1 ELSE 1 END) AS x FROM hashed GROUP BY ALL)")
    + "SELECT chunk_ord, list(CAST(coalesce(x, 0) AS FLOAT) ORDER BY i) AS embedding FROM (SELECT chunk_ord, i FROM chunks, range(256) t(i)) LEFT JOIN cells USING (chunk_ord, i) GROUP BY chunk_ord"
)
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    text = T.embedding_text(F.col("content"), F.col("file_path"), F.col("kind"), F.col("name"), F.col("language"))
    return vectors.embedded(rows.select("chunk_ord", text.alias("text")), F.col("text"), vectors.HashingModel()).select("chunk_ord", "embedding")


# What follows has no table to run over; the tests hold it against literal expectations.


@query()
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This package's own source tree."""
    from pathlib import Path

    return tree.scan(reach(spark), str(Path(__file__).parent))
