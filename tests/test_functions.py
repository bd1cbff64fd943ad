"""Column functions against the driver's and against literal expectations."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import paths, rank
from quarry.functions import terms as Q
from quarry.functions import text as T
from quarry.plans.hybrid import query_frame


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abcesindgrtABX_019 .é\n", max_size=40), min_size=1, max_size=40))
def test_tokens_as_driver(spark, values):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string").select("x", T.tokens(F.col("x")).alias("t"), T.name_tokens(F.col("x")).alias("n")).collect()
    for r in rows:
        assert r["t"] == Q.tokenize(r["x"])
        assert r["n"] == Q.distinct(y for t in Q.tokenize(r["x"]) for y in [t, *Q.stems(t)])


def test_paths(spark):
    tests = ["tests/a.py", "src/test_a.py", "src/a_test.go", "src/a.spec.ts", "src/FooTest.java", "src/jvmTest/a.kt", "a\\tests\\b.py"]
    others = ["src/contest.py", "src/latest/a.py", "src/testimony.py"]
    rows = spark.createDataFrame([(x,) for x in tests + others], "p string").select("p", paths.is_test_file(F.col("p")).alias("t")).collect()
    assert {r["p"] for r in rows if r["t"]} == set(tests)
    prior = {"src/__init__.py": 0.425, "src/_impl.py": 0.85, "docs/a.py": 0.4, "api/x.pb.go": 0.25, "a.d.ts": 0.7, "tests/a.py": 0.3, "src/a.py": 1.0, "pkg/package-info.java": 0.5}
    rows = spark.createDataFrame([(x,) for x in prior], "p string").select("p", F.round(paths.prior(F.col("p"), F.lit(False)), 9).alias("v"), paths.prior(F.col("p"), F.lit(True)).alias("w")).collect()
    assert {r["p"]: r["v"] for r in rows} == prior and {r["p"]: r["w"] for r in rows}["tests/a.py"] == 1.0


def test_path_parts(spark):
    assert set(one(spark, T.path_tokens(F.col("p")), p="src\\cache/./store_items.py")) == {"store_items", "store_item", "store", "items", "item", "py", "src", "cache"}
    assert one(spark, T.stem(F.col("p")), p=".bashrc") == ".bashrc" and one(spark, T.stem(F.col("p")), p="a.tar.gz") == "a.tar"


def bonus(spark, name, query):
    asked = query_frame(spark, [query])
    return asked.select(rank.name_bonus(F.lit(name), F.col("search_text"), F.col("compact"), F.col("word_compacts"), F.col("raw_terms"))).first()[0]


def test_name_bonus(spark):
    assert bonus(spark, "CacheBuilder", "CacheBuilder") == 1.6
    assert bonus(spark, "build", "the build step") == 1.2
    assert 0.55 < bonus(spark, "CacheBuilderFactory", "CacheBuilder") < 1.1
    assert bonus(spark, "execute_search_request", "search request") == 0.7
    assert bonus(spark, "MyCacheBuilder", "cachebuilder") == 0.45
    assert bonus(spark, "other", "CacheBuilder") == 0.0 and bonus(spark, "", "x y") == 0.0


def test_relevance_prefers_cooccurrence(spark):
    asked = query_frame(spark, ["execute search request"])
    chunks = spark.createDataFrame([("def execute_search_request(): pass", "src/search.py", "function", "execute_search_request", "python"), ("def execute(): pass", "src/run.py", "function", "execute", "python")], "content string, file_path string, kind string, name string, language string")
    rows = chunks.crossJoin(asked)
    c = {x: F.col(x) for x in rows.columns}
    found = {r[0]: r[1] for r in rows.select("name", rank.relevance_factor(c, c)).collect()}
    assert found["execute_search_request"] > found["execute"]


def test_first_line(spark):
    assert one(spark, rank.first_line(F.col("t")), t="\n \t Def Foo():\r\n x") == "def foo():"
    assert one(spark, rank.first_line(F.col("t")), t="  ") == ""


def test_texts(spark):
    assert one(spark, T.embedding_text(*(F.col(x) for x in "cpknl")), c="body", p="a/b.py", k="file", n="", l="python") == "path: a/b.py\nkind: file\nlanguage: python\n\nbody"
    assert one(spark, T.enriched(*(F.col(x) for x in "cpknl")), c="body", p="r/a/b/c/d.py", k="file", n="f", l="python") == "body d d a b c file f python"
