"""The queries' SQL in DuckDB's dialect, put together from common table expressions."""

from __future__ import annotations

import re

from quarry.functions import paths, rank
from quarry.functions.terms import ALIASES, FILTER, HINT, QUERY, QUESTION, RELATION, STOP_WORDS, SYMBOL, TEST, TOKEN, query_row
from quarry.operators.graph import KEYWORDS
from quarry.schema import COHERENCE, DEFINITION_BOOST, IMPORT_BOOST, MOST_IDENTIFIERS, REFERENCE_BOOST, RRF_K, SATURATION, SEEDS, SUFFIXES


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strings(values) -> str:  # noqa: ANN001
    return "CAST([" + ", ".join(quote(x) for x in values) + "] AS VARCHAR[])"


def split_token(t: str) -> str:
    parts = (
        f"(CASE WHEN contains({t}, '_') THEN list_filter(string_split(lower({t}), '_'), lambda y: y <> '') "
        f"ELSE list_transform(regexp_extract_all(regexp_replace({t}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda y: lower(y)) END)"
    )
    return f"(CASE WHEN len({parts}) > 1 THEN list_concat([lower({t})], {parts}) ELSE [lower({t})] END)"


def tokens(e: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({e}, '{TOKEN}'), lambda t: {split_token('t')}))"


def stems(t: str) -> str:
    n = f"length({t})"
    cut = lambda k: f"{t}[1:{n} - {k}]"
    end = lambda *s: "(" + " OR ".join(f"suffix({t}, '{x}')" for x in s) + ")"
    at = lambda k: f"substr({t}, {n} - {k - 1}, 1)"
    without = lambda k: f"list_concat([{cut(k)}, {cut(k)} || 'e'], CASE WHEN {n} > {k + 1} AND {at(k + 1)} = {at(k + 2)} THEN [{cut(k + 1)}] ELSE [] END)"
    rules = [
        (f"{end('ing')} AND {n} > 5", without(3)),
        (f"{end('tion', 'sion')} AND {n} > 5", f"[{cut(3)}]"),
        (f"{end('ment')} AND {n} > 6", f"[{cut(4)}]"),
        (f"{n} > 4 AND {end('ies')}", f"[{cut(3)} || 'y']"),
        (f"{n} > 4 AND {end('es')} AND NOT {end('ies')}", f"CASE WHEN {at(3)} IN ('s', 'x', 'z') THEN [{cut(2)}] ELSE [{cut(2)}, {cut(1)}] END"),
        (f"{n} > 4 AND {end('s')} AND NOT {end('ss', 'es')}", f"[{cut(1)}]"),
        (f"{n} > 4 AND {end('ed')} AND NOT {end('eed')}", f"[{cut(1)}, {cut(2)}]"),
        (f"{n} > 5 AND {end('ied')}", f"[{cut(3)} || 'y']"),
        (f"{n} > 4 AND {end('er')}", without(2)),
    ]
    every = ", ".join(f"CASE WHEN {c} THEN {v} ELSE [] END" for c, v in rules)
    return f"list_sort(list_distinct(list_filter(flatten([{every}]), lambda x: length(x) > 2 AND x <> {t})))"


def with_stems(e: str) -> str:
    return f"list_distinct(flatten(list_transform({e}, lambda s: list_concat([s], {stems('s')}))))"


def parts(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda x: x NOT IN ('', '.'))"


def file_name(p: str) -> str:
    return f"coalesce({parts(p)}[-1], '')"


def stem(name: str) -> str:
    return f"regexp_replace({name}, '^((?s:.+))\\.[^.]+$', '\\1')"


def dirs(p: str) -> str:
    return f"{parts(p)}[1:len({parts(p)}) - 1]"


def slashes(p: str) -> str:
    return f"replace({p}, '\\', '/')"


def path_tokens(p: str) -> str:
    s = slashes(p)
    text = f"concat_ws(' ', {file_name(s)}, {stem(file_name(s))}, array_to_string({dirs(s)}, ' '))"
    return with_stems(tokens(text))


def joined(e: str) -> str:
    return f"array_to_string(list_sort({e}), ' ')"


def compact(e: str) -> str:
    return f"lower(regexp_replace({e}, '[^a-zA-Z0-9_]+', '', 'g'))"


def matches_any(t: str, candidates: str) -> str:
    return f"(len(list_filter({candidates}, lambda c: c = {t} OR (length(c) > 2 AND starts_with({t}, c)) OR (length({t}) > 2 AND starts_with(c, {t})))) > 0)"


CHUNKS = r"""chunks AS (
  SELECT doc_id AS chunk_ord, 'import ' || source || '.doc_' || CAST((doc_id * 7) % 200 AS VARCHAR) || chr(10) || text AS content,
    CASE doc_id % 9 WHEN 0 THEN 'src/' || source || '/core.py' WHEN 1 THEN 'tests/test_' || doc_id || '.py' WHEN 2 THEN 'src/_doc_' || doc_id || '.py'
      WHEN 3 THEN 'examples/' || source || '/doc_' || doc_id || '.js' WHEN 4 THEN 'src/' || source || '/__init__.py' WHEN 5 THEN 'api/doc_' || doc_id || '.pb.go'
      WHEN 6 THEN 'types/doc_' || doc_id || '.d.ts' WHEN 7 THEN 'src/jvmTest/Doc' || doc_id || 'Test.kt' ELSE 'lib/' || source || '/doc_' || doc_id || '.py' END AS file_path,
    CAST(doc_id + 1 AS INT) AS start_line, CAST(doc_id + 2 + length(text) - length(replace(text, chr(10), '')) AS INT) AS end_line,
    ['function', 'method', 'class', 'module', 'file'][CAST(doc_id % 5 AS INT) + 1] AS kind,
    CASE WHEN doc_id % 5 < 3 THEN CASE WHEN doc_id % 2 = 0
      THEN array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:2], lambda w: upper(w[1:1]) || w[2:]), '')
      ELSE array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], '_') END END AS name, lang AS language
  FROM documents)"""

DOCS = f"""docs AS (
  SELECT 'content' AS field, chunk_ord, {tokens('content')} AS tokens FROM chunks
  UNION ALL SELECT 'name', chunk_ord, {with_stems(tokens("coalesce(name, '')"))} FROM chunks
  UNION ALL SELECT 'path', chunk_ord, {path_tokens('file_path')} FROM chunks),
stats AS (SELECT field, count(*) AS n, avg(len(tokens)) AS avgdl FROM docs GROUP BY field),
postings AS (SELECT field, term, chunk_ord, dl, count(*) AS tf FROM (SELECT field, chunk_ord, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)"""


def _terms(name: str, stemmed: bool, stop_words: bool) -> str:
    """What terms.search_terms() gives, from the search texts' tokens: long ones or those with an alias, their stems, the aliases of all."""
    long, wanted = "(length(term) > 2 OR term IN (SELECT term FROM aliases))", "TRUE" if stop_words else f"term NOT IN ({STOP_ROWS})"
    more = f"UNION SELECT query_id, term FROM (SELECT query_id, unnest({stems('term')}) AS term FROM {name}_0) WHERE {long} AND {wanted}" if stemmed else ""
    return f"""{name}_0 AS (SELECT DISTINCT query_id, term FROM query_tokens WHERE {long} AND {wanted}),
{name}_1 AS (SELECT query_id, term FROM {name}_0 {more}),
{name} AS (SELECT query_id, list(DISTINCT term) AS {name} FROM (SELECT query_id, term FROM {name}_1 UNION SELECT query_id, alias FROM (SELECT query_id, alias AS term, alias FROM {name}_1 JOIN aliases USING (term)) WHERE {wanted}) GROUP BY query_id)"""


def parsed_cte(source: str, alpha: float | None = None) -> str:
    """`queries` of the rows (query_id, raw) of a source, parsed and classified here; of texts without quotes and backslashes, which a shell would take away. All of terms.QUERY but the groups."""
    field = lambda names, column: f"list_distinct(flatten(list_transform(list_filter(words, lambda w: regexp_matches(w, {quote('(?i)' + FILTER.pattern)}) AND list_contains({strings(names)}, lower(string_split(w, ':')[1])) AND len({_values('w')}) > 0), lambda w: {_values('w')}))) AS {column}"
    matches = lambda e, p: f"regexp_matches({e}, {quote(('(?i)' if p.flags & re.IGNORECASE else '') + p.pattern)})"
    symbol, hint, question, relation, tests = matches("trim(search_text)", SYMBOL), *(matches("search_text", p) for p in (HINT, QUESTION, RELATION, TEST))
    given = f"CAST({alpha!r} AS DOUBLE)" if alpha is not None else "CAST(NULL AS DOUBLE)"
    weight = lambda column, share, *of: f"CAST(CASE WHEN given IS NOT NULL THEN {share} WHEN {symbol} THEN {of[0]} WHEN {hint} THEN {of[1]} WHEN {question} THEN {of[2]} ELSE {of[3]} END AS DOUBLE) AS {column}"
    lists = ", ".join(f"coalesce({x}, CAST([] AS VARCHAR[])) AS {x}" for x in ("raw_terms", "base_terms", "content_terms", "metadata_terms"))
    return f"""aliases(term, alias) AS (VALUES {ALIAS_ROWS}),
worded AS (SELECT CAST(query_id AS BIGINT) AS query_id, raw, list_filter(regexp_split_to_array(raw, '[ \\t\\r\\n]+'), lambda w: w <> '') AS words FROM ({source}) WHERE trim(raw) <> ''),
filtered AS (SELECT query_id, raw, array_to_string(list_filter(words, lambda w: NOT (regexp_matches(w, {quote('(?i)' + FILTER.pattern)}) AND len({_values('w')}) > 0)), ' ') AS text,
  {field(['kind'], 'kinds')}, {field(['lang', 'language'], 'languages')}, {field(['path'], 'paths')}, {field(['name'], 'names')} FROM worded),
searched AS (SELECT *, CASE WHEN text <> '' THEN text ELSE raw END AS search_text, {given} AS given FROM filtered),
query_tokens AS (SELECT query_id, unnest({tokens('search_text')}) AS term FROM searched),
{_terms('raw_terms', False, True)},
{_terms('base_terms', False, False)},
{_terms('content_terms', True, False)},
{_terms('metadata_terms', True, True)},
classed AS (SELECT *, {compact('search_text')} AS compact, list_filter(regexp_split_to_array(search_text, '\\s+'), lambda w: length(w) > 1) AS long_words,
  coalesce(given, CASE WHEN {symbol} THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) AS alpha,
  {weight('w_content', '1 - given', 1.5, 1.1, 1.3, 1.2)}, {weight('w_vector', 'given', 0.4, 1.0, 1.3, 1.15)}, {weight('w_name', '2.0 * (1 - given)', 2.5, 1.2, 0.2, 0.25)},
  {weight('w_path', '2.5 * (1 - given)', 1.2, 1.2, 0.9, 1.4)}, {weight('w_symbol', '2.2 * (1 - given)', 2.5, 1.0, 0.2, 0.2)}, {relation} AS expand, {tests} AS for_tests FROM searched),
parsed AS (SELECT classed.* EXCLUDE (text, given, long_words), CASE WHEN len(long_words) > 1 THEN list_transform(long_words, lambda w: {compact('lower(w)')}) ELSE CAST([] AS VARCHAR[]) END AS word_compacts, {lists}
  FROM classed LEFT JOIN raw_terms USING (query_id) LEFT JOIN base_terms USING (query_id) LEFT JOIN content_terms USING (query_id) LEFT JOIN metadata_terms USING (query_id))"""


def _values(word: str) -> str:
    """A filter's values."""
    return f"list_filter(list_transform(string_split(regexp_extract({word}, '^[a-zA-Z]+:((?s:.+))$', 1), ','), lambda v: lower(trim(v))), lambda v: v <> '')"


def queries_cte(queries: list[str], alpha: float | None = None) -> str:
    """The stated queries, parsed by parsed_cte(). Only the concept groups come from here, as a greedy grouping isn't SQL's."""
    groups = lambda q: query_row(0, q)[QUERY_NAMES.index("groups")]
    nested = lambda x: "CAST([" + ", ".join(strings(y) for y in x) + "] AS VARCHAR[][])"
    source = " UNION ALL ".join(f"SELECT {i} AS query_id, {quote(q)} AS raw" for i, q in enumerate(queries))
    named = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, {nested(groups(q))} AS groups" for i, q in enumerate(queries))
    return parsed_cte(source, alpha) + f",\nqueries AS (SELECT parsed.*, groups FROM parsed JOIN ({named}) USING (query_id))"


QUERY_NAMES = [x.strip().split(" ")[0] for x in QUERY.split(", ")]

QUERY_TERMS = """query_terms AS (
  SELECT query_id, 'content' AS field, unnest(content_terms) AS term FROM queries
  UNION ALL SELECT query_id, 'name', unnest(metadata_terms) FROM queries
  UNION ALL SELECT query_id, 'path', unnest(metadata_terms) FROM queries)"""

SCORES = """scores AS (
  SELECT * FROM (SELECT query_id, field, chunk_ord, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf)), 9) AS score
    FROM query_terms JOIN postings USING (field, term) JOIN terms USING (field, term) JOIN stats USING (field) GROUP BY query_id, field, chunk_ord) WHERE score > 0)"""


def ranked(k: int) -> str:
    return f"field_hits AS (SELECT query_id, field, chunk_ord, score, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, chunk_ord) AS rank FROM scores QUALIFY rank <= {k})"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _has(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {quote(pattern)})"


def is_test_file(p: str) -> str:
    s = slashes(p)
    return f"({_has(f'lower({s})', paths.TEST_FILE)} OR {_has(f'lower({s})', paths.TEST_DIR)} OR {_has(file_name(s), paths.TEST_NAME)} OR {_has(s, paths.CAMEL_TEST_DIR)})"


def is_generated_file(p: str) -> str:
    return "(" + " OR ".join(_has(f"lower({slashes(p)})", x) for x in paths.GENERATED) + ")"


def prior(p: str, for_tests: str) -> str:
    low = f"lower({slashes(p)})"
    flags = {"test": f"{is_test_file(p)} AND NOT {for_tests}", "low_signal": _has(low, paths.LOW_SIGNAL), "generated": is_generated_file(p), "reexport": f"{file_name(p)} IN ({', '.join(map(quote, paths.REEXPORTS))})", "types": _has(low, paths.TYPES), "private": _has(low, paths.PRIVATE)}
    return " * ".join(["1.0::DOUBLE", *(f"CASE WHEN {f} THEN {paths.PRIORS[n]}::DOUBLE ELSE 1.0::DOUBLE END" for n, f in flags.items())])


def name_bonus(n: str = "name") -> str:
    name = f"coalesce({n}, '')"
    c = compact(name)
    all_terms = f"len(raw_terms) > 1 AND len(list_filter(raw_terms, lambda q: NOT {matches_any('q', tokens(name))})) = 0"
    return (
        f"CASE WHEN {c} = '' OR compact = '' THEN 0::DOUBLE WHEN {c} = compact THEN {rank.NAME_EXACT}::DOUBLE WHEN list_contains(word_compacts, {c}) THEN {rank.NAME_WORD}::DOUBLE "
        f"WHEN starts_with({c}, compact) THEN {rank.NAME_PREFIX}::DOUBLE + {rank.NAME_PREFIX}::DOUBLE * (length(compact) / length({c})) WHEN {all_terms} THEN {rank.NAME_TERMS}::DOUBLE WHEN contains({c}, compact) THEN {rank.NAME_PART}::DOUBLE ELSE 0::DOUBLE END"
    )


def path_bonus(p: str = "file_path") -> str:
    low = f"lower({slashes(p)})"
    name = file_name(low)
    one = (
        f"CASE WHEN q = {stem(name)} OR {matches_any('q', tokens(stem(name)))} THEN {rank.PATH_STEM}::DOUBLE WHEN contains({name}, q) THEN {rank.PATH_NAME}::DOUBLE "
        f"WHEN list_contains({dirs(low)}, q) THEN {rank.PATH_DIR}::DOUBLE WHEN {matches_any('q', tokens(low))} THEN {rank.PATH_TOKEN}::DOUBLE ELSE 0::DOUBLE END"
    )
    return f"least({rank.PATH_MOST}::DOUBLE, coalesce(list_sum(list_transform(base_terms, lambda q: {one})), 0::DOUBLE))"


def kind_bonus(k: str = "kind") -> str:
    return f"CASE lower({k}) " + " ".join(f"WHEN {quote(n)} THEN {b}::DOUBLE" for n, b in rank.KIND_BONUS.items()) + " ELSE 0::DOUBLE END"


def metadata_tokens() -> str:
    return tokens(f"concat_ws(' ', file_path, {stem(file_name('file_path'))}, array_to_string({dirs('file_path')}, '/'), kind, name, language)")


def concept_hits() -> str:
    hit = f"{matches_any('q', 'meta_tokens')} OR {matches_any('q', 'content_tokens')}"
    return f"len(list_filter(groups, lambda g: len(list_filter(g, lambda q: {hit})) > 0))"


#: Reads candidates (with the chunks' and queries' columns), gives `factors`.
FACTORS = f"""parts_ AS (SELECT *, {name_bonus()} AS b_name, {path_bonus()} AS b_path, {metadata_tokens()} AS meta_tokens, list_distinct({tokens('content')}) AS content_tokens FROM candidates),
hits_ AS (SELECT * EXCLUDE (meta_tokens, content_tokens), {concept_hits()} AS hits FROM parts_),
sums_ AS (SELECT *, 1::DOUBLE + b_name + b_path + {kind_bonus()} AS plain FROM hits_),
factors AS (SELECT *, CASE WHEN len(base_terms) = 0 AND len(content_terms) = 0 THEN 1::DOUBLE ELSE greatest(0.1::DOUBLE,
  CASE WHEN hits > 1 THEN plain + least(hits, 5) * 0.12::DOUBLE WHEN len(groups) > 1 AND b_name = 0 AND b_path = 0 THEN plain * 0.75::DOUBLE ELSE plain END) END AS factor FROM sums_)"""

FIRST_LINE = r"lower(coalesce(string_split(regexp_replace(content, '^\s+', ''), chr(10))[1], ''))"
SYMBOLS = f"""symbol_scores AS (
  SELECT query_id, chunk_ord, round((b + least(0.8::DOUBLE, 0.2::DOUBLE * len(list_filter(raw_terms, lambda q: contains(line, q))))) * CASE WHEN lower(kind) IN ({', '.join(map(quote, rank.DEFINITIONS))}) THEN 1.2::DOUBLE ELSE 0.7::DOUBLE END, 9) AS score
  FROM (SELECT query_id, chunk_ord, kind, raw_terms, {FIRST_LINE} AS line, {name_bonus()} AS b FROM chunks, queries) WHERE b > 0)"""


def symbol_hits(k: int) -> str:
    return f"symbol_hits AS (SELECT query_id, chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord) AS rank FROM symbol_scores QUALIFY rank <= {k})"


def vector_hits(k: int) -> str:
    """Query i asks with the vector of row i."""
    return f"""unit AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12::DOUBLE) AS n FROM embeddings)),
vector_hits AS (SELECT q.query_id, r.vec_id AS chunk_ord, round(list_inner_product(a.u, r.u), 9) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_inner_product(a.u, r.u), 9) DESC, r.vec_id) AS rank
  FROM (SELECT query_id FROM queries) q JOIN unit a ON a.vec_id = q.query_id, unit r QUALIFY rank <= {k})"""


FUSED = f"""channel_hits AS (
  SELECT query_id, chunk_ord, rank, CASE field WHEN 'content' THEN 0 WHEN 'name' THEN 2 ELSE 3 END AS channel FROM field_hits
  UNION ALL SELECT query_id, chunk_ord, rank, 1 FROM vector_hits UNION ALL SELECT query_id, chunk_ord, rank, 4 FROM symbol_hits),
fused AS (
  SELECT query_id, chunk_ord, round(sum(w / ({RRF_K} + rank)), 12) AS score, min(channel * 1000000 + rank) AS first
  FROM (SELECT h.*, [w_content, w_vector, w_name, w_path, w_symbol][channel + 1] AS w FROM channel_hits h JOIN queries USING (query_id)) WHERE w > 0 GROUP BY query_id, chunk_ord)"""

FILTERS = f"""(len(kinds) = 0 OR list_contains(kinds, lower(kind))) AND (len(languages) = 0 OR list_contains(languages, lower(coalesce(language, ''))))
  AND (len(paths) = 0 OR len(list_filter(paths, lambda f: contains(lower({slashes('file_path')}), f))) > 0) AND (len(names) = 0 OR len(list_filter(names, lambda f: contains(lower(coalesce(name, '')), f))) > 0)"""


def reranked(k: int, penalize: bool = True) -> str:
    """Reads scored (query_id, chunk_ord, score), gives `final`."""
    penalty = prior("file_path", "for_tests") if penalize else "1.0::DOUBLE"
    return f"""candidates AS (SELECT s.query_id, s.score, c.*, q.* EXCLUDE (query_id) FROM scored s JOIN chunks c USING (chunk_ord) JOIN queries q USING (query_id) WHERE {FILTERS}),
{FACTORS},
adjusted AS (SELECT query_id, chunk_ord, file_path, start_line, {penalty} AS penalty, round(CASE WHEN score <= 0 OR alpha >= 1 THEN score ELSE greatest(score * factor, 1e-12::DOUBLE) END, 12) AS score FROM factors),
totals AS (SELECT *, round(sum(score) OVER f, 12) AS total, row_number() OVER (f ORDER BY score DESC, start_line, chunk_ord) AS best, max(score) OVER (PARTITION BY query_id) AS most FROM adjusted WINDOW f AS (PARTITION BY query_id, file_path)),
coherent AS (SELECT query_id, chunk_ord, file_path, start_line, round((score + CASE WHEN best = 1 AND most > 0 THEN most * {COHERENCE}::DOUBLE * total / max(total) OVER (PARTITION BY query_id) ELSE 0::DOUBLE END) * penalty, 9) AS score FROM totals),
saturated AS (SELECT *, round(score * pow({SATURATION}::DOUBLE, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, start_line, chunk_ord) - 1), 9) AS now FROM coherent WHERE score > 0),
final AS (SELECT query_id, chunk_ord, now AS score, row_number() OVER (PARTITION BY query_id ORDER BY now DESC, score DESC, file_path, start_line, chunk_ord) AS rank FROM saturated QUALIFY rank <= {k})"""


CHUNK_ID = "'chunk:' || file_path || ':' || start_line || ':' || end_line || ':' || kind || ':' || coalesce(name, '')"
_KEYWORDS = ", ".join(map(quote, KEYWORDS))
IDENTIFIERS = f"""found_ AS (SELECT chunk_ord, x, min(i) AS i FROM (SELECT chunk_ord, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT chunk_ord, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*') AS w FROM chunks))
  WHERE length(x) > 1 AND lower(x) NOT IN ({_KEYWORDS}) GROUP BY chunk_ord, x),
identifiers AS (SELECT chunk_ord, x FROM found_ QUALIFY row_number() OVER (PARTITION BY chunk_ord ORDER BY i) <= {MOST_IDENTIFIERS})"""
#: The adapter's chunks have one import line each, the first; no other line of the test data imports.
IMPORTS = r"imports AS (SELECT DISTINCT file_path, regexp_extract(content, '^import ([^\n]+)', 1) AS module FROM chunks)"
_SUFFIXES = ", ".join(map(quote, SUFFIXES))
_BARE = f"regexp_replace(CASE WHEN lower(regexp_extract({file_name('file_path')}, '^.+(\\.[^.]+)$', 1)) IN ({_SUFFIXES}) THEN file_path[1:length(file_path) - length(regexp_extract({file_name('file_path')}, '^.+(\\.[^.]+)$', 1))] ELSE file_path END, '/__init__$', '')"


def tails(p: str) -> str:
    return f"list_distinct(flatten(list_transform(range(1, len({p}) + 1), lambda i: [array_to_string({p}[i:], '.'), array_to_string({p}[i:], '/')])))"


MODULES = f"""files AS (SELECT DISTINCT file_path FROM chunks),
module_names AS (SELECT file_path, unnest({tails('p')}) AS module FROM (SELECT file_path, {parts(_BARE)} AS p FROM files)),
unique_modules AS (SELECT module, min(file_path) AS file FROM module_names GROUP BY module HAVING count(DISTINCT file_path) = 1)"""
RESOLVED = f"""lookups AS (SELECT file_path, module, unnest(list_distinct(list_concat([module], {tails('p')}))) AS name FROM (SELECT *, list_filter(regexp_split_to_array(module, '[/.]'), lambda x: x <> '') AS p FROM imports)),
resolved AS (SELECT file_path, l.module, arg_max(u.file, (length(l.name), l.name)) AS target FROM lookups l JOIN unique_modules u ON u.module = l.name GROUP BY file_path, l.module)"""
EDGES = f"""edges AS (SELECT source_id, target_id, kind, max(confidence) AS confidence FROM (
  SELECT 'file:' || file_path AS source_id, {CHUNK_ID} AS target_id, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM chunks
  UNION ALL SELECT 'file:' || file_path, 'symbol:' || file_path || ':' || name, 'defines', 1.0 FROM chunks WHERE name <> ''
  UNION ALL SELECT {CHUNK_ID}, 'symbol:' || file_path || ':' || name, 'defines', 1.0 FROM chunks WHERE name <> ''
  UNION ALL SELECT 'file:' || file_path, 'module:' || module, 'imports', 0.95 FROM imports
  UNION ALL SELECT 'file:' || file_path, 'file:' || target, 'imports', 1.0 FROM resolved
  UNION ALL SELECT {CHUNK_ID}, 'identifier:' || lower(x), 'references', 0.55 FROM identifiers JOIN chunks USING (chunk_ord)) GROUP BY ALL)"""
NODES = f"""nodes AS (
  SELECT 'file:' || file_path AS id, 'file' AS kind, file_path AS label, file_path, NULL AS chunk_id, NULL AS language FROM files
  UNION ALL (SELECT {CHUNK_ID} AS id, 'chunk', file_path || ':' || start_line || '-' || end_line, file_path, {CHUNK_ID}, language FROM chunks QUALIFY row_number() OVER (PARTITION BY {CHUNK_ID} ORDER BY chunk_ord) = 1)
  UNION ALL (SELECT 'symbol:' || file_path || ':' || name, 'symbol', name, file_path, {CHUNK_ID}, language FROM chunks WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY chunk_ord) = 1)
  UNION ALL SELECT DISTINCT 'module:' || module, 'module', module, NULL, NULL, NULL FROM imports
  UNION ALL SELECT 'identifier:' || lower(x), 'identifier', arg_min(x, (chunk_ord, x)), NULL, NULL, NULL FROM identifiers GROUP BY lower(x))"""
_SHORT = ", ".join(quote(a) for a in ALIASES if len(a) < 3)
LOOKUP = f"""neighbours AS (SELECT DISTINCT file, other FROM (SELECT file_path AS file, target AS other FROM resolved UNION ALL SELECT target, file_path FROM resolved)),
definitions AS (SELECT DISTINCT chunk_ord, term FROM (SELECT chunk_ord, unnest({tokens('name')}) AS term FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY {CHUNK_ID} ORDER BY chunk_ord DESC) = 1) WHERE name <> '') WHERE length(term) > 2 OR term IN ({_SHORT})),
refs AS (SELECT DISTINCT chunk_ord, lower(x) AS term FROM identifiers)"""
#: Reads fused; lifts run along the seeds in their order.
EXPANDED = f"""seeds AS (SELECT query_id, chunk_ord AS seed, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS place FROM fused JOIN queries USING (query_id) WHERE expand QUALIFY place <= {SEEDS}),
links AS (SELECT seed, chunk_ord, max(boost) AS boost FROM (
  SELECT seed, c.chunk_ord, {IMPORT_BOOST}::DOUBLE AS boost FROM (SELECT DISTINCT seed FROM seeds) s JOIN chunks o ON o.chunk_ord = s.seed JOIN neighbours n ON n.file = o.file_path JOIN chunks c ON c.file_path = n.other
  UNION ALL SELECT seed, d.chunk_ord, {DEFINITION_BOOST}::DOUBLE FROM (SELECT DISTINCT seed FROM seeds) s JOIN refs r ON r.chunk_ord = s.seed JOIN definitions d USING (term)
  UNION ALL SELECT seed, r.chunk_ord, {REFERENCE_BOOST}::DOUBLE FROM (SELECT DISTINCT seed FROM seeds) s JOIN definitions d ON d.chunk_ord = s.seed JOIN refs r USING (term)) GROUP BY seed, chunk_ord),
inner_ AS (SELECT a.query_id, a.place AS frm, b.place AS "to", boost FROM seeds a JOIN links l ON l.seed = a.seed JOIN seeds b ON b.query_id = a.query_id AND b.seed = l.chunk_ord WHERE a.place < b.place),
chains AS (SELECT query_id, place AS at_, score AS e FROM seeds UNION SELECT c.query_id, i."to", c.e * i.boost FROM chains c JOIN inner_ i ON i.query_id = c.query_id AND i.frm = c.at_),
finals AS (SELECT query_id, at_ AS place, max(e) AS e FROM chains GROUP BY query_id, at_),
scored AS (SELECT query_id, chunk_ord, max(score) AS score FROM (SELECT query_id, chunk_ord, score FROM fused
  UNION ALL SELECT f.query_id, l.chunk_ord, f.e * l.boost FROM finals f JOIN seeds s USING (query_id, place) JOIN links l USING (seed)) GROUP BY query_id, chunk_ord)"""
ALIAS_ROWS = ", ".join(f"({quote(k)}, {quote(v)})" for k, vs in ALIASES.items() for v in vs)
STOP_ROWS = ", ".join(map(quote, STOP_WORDS))
