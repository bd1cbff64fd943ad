"""The code graph, scans, chunks, the store and the command line."""

import json
import posixpath
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry import store
from quarry.cli import main
from quarry.operators import graph
from quarry.output import as_json
from quarry.plans.hybrid import query_frame
from quarry.schema import CHUNK
from quarry.sources import tree
from quarry.sources.chunker import chunk_source


def frame(spark, rows):
    return spark.createDataFrame([(i, c, p, i + 1, i + 2, k, n, lang) for i, (c, p, k, n, lang) in enumerate(rows)], f"chunk_ord long, {CHUNK}")


PROJECT = [("from auth.token import verify_token\nimport os", "src/app.py", "module", None, "python"), ("def verify_token(value):\n    return value", "src/auth/token.py", "function", "verify_token", "python"), ("def run():\n    verify_token(1)", "src/app.py", "function", "run", "python")]


def edges(spark, rows):
    return {(r[0], r[1], r[2]) for r in graph.edges(frame(spark, rows)).collect()}


def test_python_project(spark):
    got = edges(spark, PROJECT)
    assert {("file:src/app.py", "module:auth.token", "imports"), ("file:src/app.py", "file:src/auth/token.py", "imports"), ("file:src/app.py", "symbol:src/app.py:run", "defines")} <= got
    assert ("chunk:src/app.py:3:4:function:run", "identifier:verify_token", "references") in got
    nodes = {r["id"]: r for r in graph.nodes(frame(spark, PROJECT)).collect()}
    assert nodes["symbol:src/auth/token.py:verify_token"]["chunk_id"] == "chunk:src/auth/token.py:2:3:function:verify_token"
    assert {a for a, *_ in got} | {b for _, b, _ in got} <= set(nodes)


def test_relative_imports(spark):
    got = edges(spark, [('import { x } from "./utils";', "src/app.ts", "module", None, "typescript"), ("export const x = 1", "src/utils.ts", "module", None, "typescript"), ("from . import helper", "pkg/a.py", "module", None, "python"), ("y = 1", "pkg/helper.py", "module", None, "python")])
    assert ("file:src/app.ts", "file:src/utils.ts", "imports") in got and ("file:pkg/a.py", "file:pkg/helper.py", "imports") in got


@pytest.mark.parametrize(("source", "language", "found"), [
    ("import a, b as c\nfrom m.n import x\nfrom . import p, *\nfrom .q import r", "python", [".p", ".q", "a", "b", "m.n"]), ("const x = require('y'); export {a} from \"./b\"", "javascript", ["./b", "y"]), ('import (\n  "fmt"\n  alias "a/b"\n)', "go", ["a/b", "fmt"]),
    ("use a::b as c;", "rust", ["a::b"]), ("import static a.b.*;\nimport c.d", "java", ["a.b"]), ("#include <x/y.h>", "c", ["x/y.h"]), ("import ;", "python", []), ("use x::y;\n#include \"z\"", None, ["x::y", "z"]),
])
def test_imports(source, language, found):
    assert graph.imports_in(source, language) == found


def test_identifiers(spark):
    text = "def Foo foo x " + " ".join(f"name{i}" for i in range(300))
    got = spark.range(1).select(graph.identifiers(F.lit(text))).first()[0]
    assert len(got) == 200 and got[:3] == ["Foo", "foo", "name0"]


SOURCE = '''import os

VALUE = 1

@wraps
def top(x):
    return x

class Box:
    """A box."""

    @property
    def method(self):
        return 1
'''


def test_python_chunks():
    got = [(c[4], c[5], c[2], c[3]) for c in chunk_source(SOURCE, "src/a.py")]
    assert got == [("module", None, 1, 4), ("function", "top", 5, 7), ("class", "Box", 9, 11), ("method", "Box.method", 12, 14)]


def test_javascript_chunks():
    source = "// class X {\nfunction go(a) {\n  if (a) { return '}' }\n}\n\nclass Cart {\n  total(x) {\n    return x;\n  }\n}\n"
    got = [(c[4], c[5]) for c in chunk_source(source, "src/a.js")]
    assert ("function", "go") in got and ("class", "Cart") in got and ("method", "Cart.total") in got and got[-1] == ("module", None)


def test_chunk_edges():
    assert chunk_source("  \n", "a.py") == [] and chunk_source("text", "README.md") == []
    assert [(c[4], c[6]) for c in chunk_source("X = 1\n", "a.py")] == [("file", "python")]
    assert [(c[4], c[6]) for c in chunk_source("x", "a.py", "Nolang")] == [("file", "nolang")]
    assert [c[4] for c in chunk_source("def broken(:\n", "a.py")] == ["file"]


def make_tree(root):
    files = {"src/app.py": "def run():\n    pass\n", "src/app.js": "const x = 1", "src/README.md": "no", "src/blank.py": " \n", ".venv/hidden.py": "x = 1", "src/__init__.py": "y = 1", "src/_impl.py": "z = 1", ".hid/h.py": "h = 1", "src/X.PY": "u = 1", "src/big.py": "a" * 1_000_001}
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/crlf.py").write_bytes(b"a = 1\r\nb = '\xff'\r\n")


def test_scan(spark, tmp_path):
    make_tree(tmp_path)
    rows = tree.scan(spark, str(tmp_path)).orderBy("chunk_ord").collect()
    assert [r["file_path"] for r in rows] == [".hid/h.py", "src/X.PY", "src/__init__.py", "src/_impl.py", "src/app.js", "src/app.py", "src/crlf.py"]
    assert rows[-1]["content"] == "a = 1\nb = '�'\n"
    assert [r["file_path"] for r in tree.scan(spark, str(tmp_path), [".JS"]).collect()] == ["src/app.js"]
    with pytest.raises(FileNotFoundError):
        tree.scan(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        tree.scan(spark, str(tmp_path / "src/app.py"))


def test_store(spark, tmp_path):
    root, home = tmp_path / "root", tmp_path / "home"
    make_tree(root)
    assert not store.index_exists(str(root), home)
    built = store.load_or_build(spark, str(root), home=home)
    first = [(r["file_path"], round(r["score"], 6)) for r in built.search("run app").collect()]
    assert first and store.index_exists(str(root), home)
    again = store.load_or_build(spark, str(root), home=home)
    assert [(r["file_path"], round(r["score"], 6)) for r in again.search("run app").collect()] == first
    meta = json.loads((Path(store.index_dir(str(root), home).removeprefix("file://")) / "metadata.json").read_text())
    assert meta["chunk_count"] == built.chunks.count() and meta["vector_shape"] == [meta["chunk_count"], 256]
    (Path(store.index_dir(str(root), home).removeprefix("file://")) / "metadata.json").write_text(json.dumps(meta | {"root_path_sha256": "x"}))
    assert not store.index_exists(str(root), home)


def test_json_and_command(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(store, "HOME", tmp_path / "home")
    monkeypatch.setattr(store.load_or_build, "__defaults__", (None, False, tmp_path / "home"))
    make_tree(tmp_path / "root")
    main([str(tmp_path / "root"), "run"])
    out = json.loads(capsys.readouterr().out)
    assert out["query"] == "run" and out["results"][0]["chunk"]["location"] == "src/app.py:1-2"
    assert set(out["results"][0]["chunk"]) == {"content", "file_path", "start_line", "end_line", "kind", "name", "language", "location"}
    none = as_json(store.load_or_build(spark, str(tmp_path / "root")).search_batch(["zzz"]).where("false"), query_frame(spark, ["zzz"])).first()
    assert json.loads(none["json"]) == {"query": "zzz", "results": []}


def test_deep_sources():
    """Nested beyond what parsers take: whole files; any end of a line counts for Python."""
    for source in ("-" * 100_000 + "1", "not " * 50_000 + "x", "(" * 5000, "a" + ".b" * 100_000, "class A {" * 2000, "lambda:" * 20_000, "x = [" * 3000):
        for name in ("a.py", "a.js"):
            assert [x[4] for x in chunk_source(source, name)] == ["file"]
    assert [x[4:6] for x in chunk_source("x=1\rdef f():\r  pass\rclass A:\r\n  def g(self): return 1\r\n", "a.py")] == [("function", "f"), ("class", "A"), ("method", "A.g")]


def candidates(importer, module):
    """A plain version."""
    base = posixpath.dirname(importer)
    if module.startswith(("./", "../")):
        to = posixpath.normpath(posixpath.join(base, module))
    else:
        rest = module.lstrip(".")
        for _ in range(len(module) - len(rest) - 1):
            base = posixpath.dirname(base)
        to = posixpath.normpath(posixpath.join(base, rest.replace(".", "/")))
    return [to + x for x in graph._ENDINGS] if to != "." else []


def test_relative_files(spark):
    cases = [(i, m) for i in ("a/b/c.py", "c.py", "/a/b.js", "a/../b/c.ts", "x/y/z/w.py") for m in ("./d", "../d", "../../d/./e", "../../../d", ".d", "..d.e", "...d", ".", "..", "./", "./d.js", "../..", ".....far")]
    got = spark.createDataFrame(cases, "i string, m string").select("i", "m", graph.relative_files(F.col("i"), F.col("m")).alias("f")).collect()
    assert [(r["i"], r["m"], r["f"]) for r in got] == [(i, m, candidates(i, m)) for i, m in cases]
