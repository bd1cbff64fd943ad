"""The code graph of chunks: nodes and edges, imports resolved to files, and expansion by one hop."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.segments import first_words, slices
from quarry.functions.terms import ALIASES
from quarry.schema import CONTAINS, DEFINES, DEFINITION_BOOST, IMPORT_BOOST, IMPORTS_FILE, IMPORTS_MODULE, MOST_IDENTIFIERS, REFERENCE_BOOST, REFERENCES, SEEDS, SUFFIXES
from quarry.shared import written

#: Identifiers that are a language's own words.
KEYWORDS = tuple(
    """
    and as async await break case catch class const continue def default defer do else elif enum except export extends false final finally for from func function
    if impl import in include interface is lambda let match mod namespace new nil none not null package pass private protected public raise require return self
    static struct super switch this throw throws true try type undefined use using var void while with yield
    """.split()
)
#: What imports look like, by family of languages; group 1 is the module.
IMPORTS = {
    "js": (r"""(?:import|export)\s+(?:[^'"]*?\s+from\s+)?["']([^"']+)["']""", r"""require\s*\(\s*["']([^"']+)["']\s*\)"""),
    "java": (r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)(?:\.\*)?\s*;",),
    "go": (r'^\s*(?:import\s+)?(?:[A-Za-z_][A-Za-z0-9_]*\s+)?["]([^"]+)["]\s*;?$',),
    "include": (r"""^\s*#\s*include\s+[<"]([^>"]+)[>"]""",),
    "rust": (r"^\s*use\s+([A-Za-z_][\w:]*)(?:\s+as\s+\w+)?\s*;",),
}
#: Python's two forms of imports.
PYTHON_IMPORT = r"^\s*import\s+(.+)$"
PYTHON_FROM = r"^\s*from\s+([.\w]+)\s+import\s+(.+)$"
#: Languages and their family; others, and none, look for all.
FAMILIES = {
    "python": ("python",), "javascript": ("js",), "typescript": ("js",), "tsx": ("js",), "jsx": ("js",), "go": ("go",), "rust": ("rust",), "java": ("java",), "kotlin": ("java",), "scala": ("java",),
    "c": ("include",), "cpp": ("include",), "c_sharp": ("include",), "objc": ("include",), "objective-c": ("include",),
}


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def chunk_id(c: DataFrame | None = None) -> Column:
    part = [F.lit("chunk:"), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), F.col("end_line").cast("string"), F.lit(":"), "kind", F.lit(":"), F.coalesce("name", F.lit(""))]
    return F.concat(*part)


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit(":"), name)


def identifiers(content: Column) -> Column:
    """The first 200 different identifiers of two letters or more, but keywords, in order."""
    found = F.array_distinct(F.regexp_extract_all(content, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0))
    return F.slice(F.filter(found, lambda x: (F.length(x) > 1) & ~F.lower(x).isin(*KEYWORDS)), 1, MOST_IDENTIFIERS)


def _first_name(part: str) -> str:
    words = part.strip().rstrip(";").split(" as ", 1)[0].split()
    return words[0] if words else ""


def python_imports(line: str) -> list[str]:
    """`import a, b as c` gives a and b, `from m import x` gives m, `from . import a` gives .a"""
    if m := re.match(PYTHON_IMPORT, line):
        return [x for x in map(_first_name, m[1].split(",")) if x]
    if m := re.match(PYTHON_FROM, line):
        if m[1].strip("."):
            return [m[1]]
        return [m[1] + x for x in map(_first_name, m[2].split(",")) if x and x != "*"]
    return []


def imports_in(source: str, language: str | None) -> list[str]:
    """The modules that a source's lines import, sorted, each once."""
    families = FAMILIES.get((language or "").lower(), ("python", *IMPORTS))
    found: set[str] = set()
    for line in filter(re.compile(_HINTS).search, source.splitlines()):
        for family in families:
            if family == "python":
                found.update(python_imports(line))
            else:
                found.update(m[1].strip() for pattern in IMPORTS[family] for m in re.finditer(pattern, line))
    return sorted(found - {""})


#: Lines without any of these import nothing.
_HINTS = "import|export|require|include|use|\""


#: What a relative import's path may lack: a suffix, or the name of a directory's own file.
_ENDINGS = ["", *(middle + s for middle in ("", "/index", "/__init__") for s in sorted(SUFFIXES))]


def relative_files(importer: Column, module: Column) -> Column:
    """The files that a relative import may mean, the likeliest first: `./a/b` and `../a` as paths, `.a.b` as a module, each dot after the first a directory up."""
    base = F.regexp_extract(importer, "(?s)^(.*)/[^/]*$", 1)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    folders = F.split(base, "/")
    above = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0))), "/")
    slashed = F.startswith(module, F.lit("./")) | F.startswith(module, F.lit("../"))
    path = F.when(slashed, F.concat(base, F.lit("/"), module)).otherwise(F.concat(above, F.lit("/"), F.replace(F.substr(module, dots + 1), F.lit("."), F.lit("/"))))
    root = F.when(F.startswith(importer, F.lit("/")), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    back = lambda a, x: F.when((x != "..") | (F.size(a) == 0) & (root == "") | (F.try_element_at(a, F.lit(-1)) == ".."), F.concat(a, F.array(x))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
    folded = F.aggregate(parts, F.array().cast("array<string>"), back)
    to = F.concat(root, F.array_join(folded, "/"))
    return F.when(to != "", F.transform(F.array(*map(F.lit, _ENDINGS)), lambda x: F.concat(to, x))).otherwise(F.array().cast("array<string>"))


def imports(chunks: DataFrame) -> DataFrame:
    """file_path, module: each once."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for at, to in slices(batch.column(1)):
                paths, texts, languages = (batch.column(i).slice(at, to - at).to_pylist() for i in range(3))
                found = sorted({(p, m) for p, x, y in zip(paths, texts, languages) for m in imports_in(x, y)}, key=str)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(2)], ["file_path", "module"])

    rows = chunks.where(F.rlike("content", F.lit(_HINTS)))
    return rows.select("file_path", "content", "language").mapInArrow(run, "file_path string, module string").distinct()


def tails(parts: Column) -> Column:
    """All ends of a path, joined by dots and by slashes."""
    n = F.size(parts)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.array(F.slice(parts, i, n)), lambda p: F.array(F.array_join(p, "."), F.array_join(p, "/")))[0])))


def module_names(path: Column) -> Column:
    """What a file may be imported as."""
    suffix = F.lower(F.regexp_extract(T.file_name(path), r"^.+(\.[^.]+)$", 1))
    bare = F.when(suffix.isin(*SUFFIXES), F.substring(path, F.lit(1), F.length(path) - F.length(suffix))).otherwise(path)
    bare = F.regexp_replace(bare, "/__init__$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: ~x.isin("", "."))
    return F.when(F.size(parts) > 0, tails(parts)).otherwise(F.array().cast("array<string>"))


def unique_modules(files: DataFrame) -> DataFrame:
    """module, file: of the names that one file only has. files: file_path, each once."""
    names = files.select("file_path", F.explode(module_names(F.col("file_path"))).alias("module"))
    return names.groupBy("module").agg(F.min("file_path").alias("file"), F.max("file_path").alias("_last")).where("file = _last").drop("_last")


def module_lookups(module: Column) -> Column:
    """The names to look an import up by: it and its ends, the longest first."""
    bare = F.regexp_replace(F.trim(module), "^;+|;+$", "")
    parts = F.filter(F.split(bare, "[/.]"), lambda x: x != "")
    found = F.array_distinct(F.concat(F.array(bare), F.when(F.size(parts) > 0, tails(parts)).otherwise(F.array().cast("array<string>"))))
    order = F.array_sort(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.transform(F.reverse(order), lambda x: x["x"]))


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, module, target: the project's file that an import means, if there is one. found: file_path, module."""
    names = found.where(~F.startswith("module", F.lit("."))).select("file_path", "module", F.posexplode(module_lookups(F.col("module"))).alias("at", "name"))
    absolute = names.join(unique_modules(files).withColumnRenamed("module", "name"), "name").select("file_path", "module", "at", F.col("file").alias("target"))
    dotted = found.where(F.startswith("module", F.lit(".")))
    tries = dotted.select("file_path", "module", F.posexplode(relative_files(F.col("file_path"), F.col("module"))).alias("at", "target"))
    relative = tries.join(files.select(F.col("file_path").alias("target")), "target", "left_semi").select("file_path", "module", "at", "target")
    return absolute.unionByName(relative).groupBy("file_path", "module").agg(F.min_by("target", "at").alias("target"))


def nodes(chunks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The graph's nodes, each once; of several chunks that give one, the first decides. found: imports(chunks)."""
    found = imports(chunks) if found is None else found
    none = F.lit(None).cast("string")
    files = chunks.select("file_path").distinct().select(file_id(F.col("file_path")).alias("id"), F.lit("file").alias("kind"), F.col("file_path").alias("label"), "file_path", none.alias("chunk_id"), none.alias("language"), F.lit(-1).cast("long").alias("ord"))
    own = chunks.select(chunk_id().alias("id"), F.lit("chunk").alias("kind"), T.location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("label"), "file_path", chunk_id().alias("chunk_id"), "language", F.col("chunk_ord").alias("ord"))
    symbols = chunks.where("name <> ''").select(symbol_id(F.col("file_path"), F.col("name")).alias("id"), F.lit("symbol").alias("kind"), F.col("name").alias("label"), "file_path", chunk_id().alias("chunk_id"), "language", F.col("chunk_ord").alias("ord"))
    first = F.min_by(F.struct("kind", "label", "file_path", "chunk_id", "language"), "ord")
    firsts = own.unionByName(symbols).groupBy("id").agg(first.alias("n")).select("id", "n.*")
    bare = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), "label", none.alias("file_path"), none.alias("chunk_id"), none.alias("language"))
    modules = bare(found.select("module").distinct().select(F.concat(F.lit("module:"), "module").alias("id"), F.col("module").alias("label")), "module")
    names = identifier_rows(chunks).withColumn("id", F.concat(F.lit("identifier:"), F.lower("label")))
    # of an identifier's spellings, the first chunk's, and there the least
    named = bare(names.groupBy("id").agg(F.min(F.struct("chunk_ord", "label")).alias("f")).select("id", F.col("f.label").alias("label")), "identifier")
    return reduce(DataFrame.unionByName, (files.drop("ord"), firsts, modules, named))


def edges(chunks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The graph's edges, each once with its greatest confidence."""
    found = imports(chunks) if found is None else found
    row = lambda a, b, kind, c: F.struct(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    file, own = file_id(F.col("file_path")), chunk_id()
    contains = chunks.select(row(file, own, "contains", CONTAINS).alias("e"))
    symbol = symbol_id(F.col("file_path"), F.col("name"))
    defines = chunks.where("name <> ''").select(F.explode(F.array(row(file, symbol, "defines", DEFINES), row(own, symbol, "defines", DEFINES))).alias("e"))
    to_module = found.select(row(file, F.concat(F.lit("module:"), "module"), "imports", IMPORTS_MODULE).alias("e"))
    to_file = resolved_imports(found, chunks.select("file_path").distinct()).select(row(file, file_id(F.col("target")), "imports", IMPORTS_FILE).alias("e"))
    every = reduce(DataFrame.unionByName, (contains, defines, to_module, to_file)).select("e.*").groupBy("source_id", "target_id", "kind").agg(F.max("confidence").alias("confidence"))
    # a chunk refers to an identifier once, so only what chunks with one id refer to has to be brought together
    shared = written(chunks.groupBy(own.alias("own")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own"), "shared_ids")
    named = chunks.withColumn("own", own)
    refers = lambda rows: identifier_rows(rows.withColumn("chunk_ord", F.col("own")), True).select("chunk_ord", F.concat(F.lit("identifier:"), "label").alias("target_id"))
    names = refers(named.join(shared, "own", "left_anti")).unionByName(refers(named.join(shared, "own", "left_semi")).distinct())
    references = names.select(F.col("chunk_ord").alias("source_id"), "target_id", F.lit("references").alias("kind"), F.lit(REFERENCES).alias("confidence"))
    return every.unionByName(references)


def label_terms(label: Column) -> Column:
    """A symbol's terms: its tokens, each once, but short ones without an alias."""
    return F.filter(F.array_distinct(T.tokens(label)), lambda x: (F.length(x) > 2) | x.isin(*(a for a in ALIASES if len(a) < 3)))


def neighbours(graph_edges: DataFrame) -> DataFrame:
    """file, other: files that import one another, either way."""
    pair = graph_edges.where("kind = 'imports' AND startswith(source_id, 'file:') AND startswith(target_id, 'file:')").select(F.substring("source_id", 6, 1 << 30).alias("a"), F.substring("target_id", 6, 1 << 30).alias("b"))
    return pair.select(F.explode(F.array(F.struct(F.col("a").alias("file"), F.col("b").alias("other")), F.struct(F.col("b").alias("file"), F.col("a").alias("other")))).alias("n")).select("n.*").distinct()


def definitions(chunks: DataFrame) -> DataFrame:
    """term, chunk_ord: what chunks define. Chunks that share an id stand for the last."""
    last = chunks.groupBy(chunk_id().alias("id")).agg(F.max_by(F.struct("chunk_ord", "name"), "chunk_ord").alias("c")).select("c.*")
    return last.where("name <> ''").select(F.explode(label_terms(F.col("name"))).alias("term"), "chunk_ord").distinct()


def identifier_rows(chunks: DataFrame, lower: bool = False) -> DataFrame:
    """chunk_ord, label: identifiers() of each chunk, cut by whole batches; lower: in lower case, a chunk's each once."""
    kind = chunks.schema["chunk_ord"].dataType.simpleString()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for at, to in slices(batch.column(1)):
                words, number, word = first_words(batch.column(1).slice(at, to - at), list(KEYWORDS), MOST_IDENTIFIERS)
                if lower:
                    coded = pc.ascii_lower(words).dictionary_encode()
                    words, many = coded.dictionary, max(1, len(words))
                    both = np.unique(number * many + np.asarray(coded.indices, np.int64)[word])
                    number, word = both // many, both % many
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at).take(pa.array(number)), words.take(pa.array(word))], ["chunk_ord", "label"])

    return chunks.select("chunk_ord", "content").mapInArrow(run, f"chunk_ord {kind}, label string")


def reference_rows(chunks: DataFrame) -> DataFrame:
    """references(), of which rows may repeat where chunks share a number."""
    return identifier_rows(chunks, True).select(F.col("label").alias("term"), "chunk_ord")


def references(chunks: DataFrame) -> DataFrame:
    """term, chunk_ord: what chunks refer to."""
    return reference_rows(chunks).distinct()


class Lookup(NamedTuple):
    """neighbours: file, other. definitions and references: term, chunk_ord."""

    neighbours: DataFrame
    definitions: DataFrame
    references: DataFrame


def file_neighbours(chunks: DataFrame) -> DataFrame:
    """neighbours() of the chunks' graph, of which only the imports between files are made."""
    found = resolved_imports(written(imports(chunks), "imports"), chunks.select("file_path").distinct())
    both = F.array(F.struct(F.col("file_path").alias("file"), F.col("target").alias("other")), F.struct(F.col("target").alias("file"), F.col("file_path").alias("other")))
    return found.select(F.explode(both).alias("n")).select("n.*").distinct()


def lookup(chunks: DataFrame, graph_edges: DataFrame | None = None) -> Lookup:
    return Lookup(file_neighbours(chunks) if graph_edges is None else neighbours(graph_edges), definitions(chunks), reference_rows(chunks))


def seed_links(seeds: DataFrame, chunks: DataFrame, held: Lookup) -> DataFrame:
    """seed, chunk_ord, boost: what a seed's score is worth to its neighbours, at most. seeds: seed (a chunk_ord).

    What seeds are, define and refer to, some hundred rows a query, is written before it meets all chunks, so that its size is known.
    """
    seeds = seeds.select("seed").distinct()
    mine = written(seeds.join(chunks.withColumnRenamed("chunk_ord", "seed"), "seed").select("seed", "file_path", "content"), "seed_chunks")
    near = written(mine.select("seed", "file_path").join(held.neighbours, F.col("file_path") == F.col("file")).select("seed", "other").distinct(), "near")
    by_import = near.join(chunks.select("chunk_ord", F.col("file_path").alias("other")), "other").select("seed", "chunk_ord", F.lit(IMPORT_BOOST).alias("boost"))
    referred = written(references(mine.withColumnRenamed("seed", "chunk_ord")).withColumnRenamed("chunk_ord", "seed"), "referred")
    defined = written(seeds.join(held.definitions.withColumnRenamed("chunk_ord", "seed"), "seed"), "defined")
    by_definition = referred.join(held.definitions, "term").select("seed", "chunk_ord", F.lit(DEFINITION_BOOST).alias("boost"))
    by_reference = defined.join(held.references, "term").select("seed", "chunk_ord", F.lit(REFERENCE_BOOST).alias("boost"))
    return reduce(DataFrame.unionByName, (by_import, by_definition, by_reference)).groupBy("seed", "chunk_ord").agg(F.max("boost").alias("boost"))


def expand(scored: DataFrame, seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Scores with each seed's neighbours lifted to its score times the link's boost. scored: query_id, chunk_ord, score. seeds: query_id, seed, place, score.

    A seed's score counts as earlier seeds have lifted it. The seeds' links among one another are at most SEEDS squared
    numbers a query; they are folded in order, and then all neighbours take the greatest.
    """
    into = seeds.select("query_id", F.col("seed").alias("chunk_ord"), F.col("place").alias("to"))
    inner = links.withColumnRenamed("seed", "s").join(into, "chunk_ord").join(seeds.select("query_id", F.col("seed").alias("s"), F.col("place").alias("frm")), ["query_id", "s"]).where("frm < to")
    lifts = inner.groupBy("query_id", "to").agg(F.collect_list(F.struct("frm", "boost")).alias("lifts"))
    rows = seeds.join(lifts.withColumnRenamed("to", "place"), ["query_id", "place"], "left")
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "seed", "score", F.coalesce("lifts", F.array().cast("array<struct<frm:int,boost:double>>")).alias("lifts")))).alias("seeds"))
    one = lambda done, x: F.concat(done, F.array(F.greatest(x["score"], F.coalesce(F.array_max(F.transform(x["lifts"], lambda y: F.get(done, y["frm"] - 1) * y["boost"])), F.lit(0.0)))))
    folded = per.select("query_id", "seeds", F.aggregate("seeds", F.array().cast("array<double>"), one).alias("final"))
    finals = folded.select("query_id", F.explode(F.arrays_zip(F.transform("seeds", lambda x: x["seed"]).alias("seed"), F.col("final").alias("score"))).alias("s")).select("query_id", "s.seed", "s.score")
    lifted = finals.where("score > 0").join(links, "seed").select("query_id", "chunk_ord", (F.col("score") * F.col("boost")).alias("score"))
    return scored.unionByName(lifted).groupBy("query_id", "chunk_ord").agg(F.max("score").alias("score"))


def seeds_of(scored: DataFrame, tie: list[str]) -> DataFrame:
    """query_id, seed, place, score: the 20 best of each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *tie))
    return scored.withColumn("place", place).where(F.col("place") <= SEEDS).select("query_id", F.col("chunk_ord").alias("seed"), "place", "score")
