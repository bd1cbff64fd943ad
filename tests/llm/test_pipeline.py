"""The pipeline: each stage on what its predecessor kept, and the queries' registration."""

from collections import Counter

import duckdb

import __spark_entry__
import corpus_pipeline
from quarry.llm import mixing, quality, secrets
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import frame, words
from tests.llm.test_corpus import classes_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    rows = [r for r in kept.collect()]
    assert kept.schema == docs.schema and 0 < len(rows) <= docs.count()
    good = {r["doc_id"] for r in quality.score(docs, ["doc_id"]).where("kept").collect()}
    assert {r["doc_id"] for r in rows} == good
    single = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    given = [(r["doc_id"], r["text"]) for r in rows]
    group = classes_of(given)
    least: dict = {}
    for (i, _), g in zip(given, group):
        least[g] = min(i, least.get(g, i))
    assert sorted(r["doc_id"] for r in single) == sorted(least.values())
    clean = corpus_pipeline.secret_scan(spark, spark.createDataFrame(single, docs.schema), sf_dir)
    texts = {r["doc_id"]: r["text"] for r in single}
    assert all(r["text"] == secrets.redact(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = corpus_pipeline.source_mix(spark, clean, sf_dir)
    times = {r["doc_id"]: r["copies"] for r in mixing.plan(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(times)
    packed = corpus_pipeline.best_fit_packing(spark, mixed, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, n in times.items() if n}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect())
    assert all(words(r["text"]) for r in mixed.collect())


def test_stages_take_anything(spark):
    """Nulls, repeated rows, columns with the names that operators use inside, and no rows at all."""
    for docs in (frame(spark), frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.schema == docs.schema, name
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert len({(r["doc_id"]) for r in packed.collect()}) == len({r["doc_id"] for r in docs.collect()})


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLE_SQL) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else repr(v)
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf_dir)
        found = con.execute(sql)
        cols = [d[0] for d in found.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(str([plain(x) for x in r]) for r in df.select(*cols).collect()) == sorted(str([plain(x) for x in r]) for r in found.fetchall()), name
