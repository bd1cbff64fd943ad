"""Rules of relevance as columns, over a chunk's columns and a query's (terms.QUERY)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Bonuses by kind, and the kinds that define something.
KIND_BONUS = {"function": 0.18, "method": 0.18, "constructor": 0.18, "class": 0.16, "interface": 0.16, "struct": 0.14, "trait": 0.14, "enum": 0.1, "module": 0.04, "file": 0.0}
DEFINITIONS = ("function", "method", "constructor", "class", "interface", "struct", "trait", "enum")
#: Bonuses of names and paths.
NAME_EXACT, NAME_WORD, NAME_PREFIX, NAME_TERMS, NAME_PART = 1.6, 1.2, 0.55, 0.7, 0.45
PATH_STEM, PATH_NAME, PATH_DIR, PATH_TOKEN, PATH_MOST = 0.28, 0.2, 0.16, 0.08, 0.8
#: What lines end with in Python's splitlines().
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
#: What Python's strip() takes away, as a class.
SPACE = r"[\s\x1C-\x1F\x85   -     　]"


def once(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once however often it stands in the result."""
    return F.transform(F.array(value), use)[0]


def name_bonus(name: Column, search_text: Column, compact: Column, word_compacts: Column, raw_terms: Column) -> Column:
    name = F.coalesce(name, F.lit(""))

    def rules(n: Column) -> Column:
        tokens = T.tokens(name)
        ratio = F.length(compact) / F.greatest(F.length(n), F.lit(1))
        all_terms = (F.size(raw_terms) > 1) & once(tokens, lambda t: F.forall(raw_terms, lambda x: T.matches_any(x, t)))
        return (
            F.when((n == "") | (compact == "") | ~F.rlike(search_text, F.lit(r"\S")), 0.0)
            .when(n == compact, NAME_EXACT)
            .when(F.array_contains(word_compacts, n), NAME_WORD)
            .when(F.startswith(n, compact), NAME_PREFIX + NAME_PREFIX * ratio)
            .when(all_terms, NAME_TERMS)
            .when(F.contains(n, compact), NAME_PART)
            .otherwise(0.0)
        )

    return once(T.compact(name), rules)


def path_bonus(path: Column, terms: Column) -> Column:
    low = F.lower(T.slashes(path))
    given = F.struct(T.file_name(low).alias("name"), T.stem(T.file_name(low)).alias("stem"), T.dirs(low).alias("dirs"), F.array_distinct(T.tokens(low)).alias("tokens"))

    def rules(p: Column) -> Column:
        stem_tokens = T.tokens(p["stem"])
        one = lambda t: (
            F.when((t == p["stem"]) | T.matches_any(t, stem_tokens), PATH_STEM).when(F.contains(p["name"], t), PATH_NAME).when(F.array_contains(p["dirs"], t), PATH_DIR).when(T.matches_any(t, p["tokens"]), PATH_TOKEN).otherwise(0.0)
        )
        return F.least(F.lit(PATH_MOST), F.aggregate(F.transform(terms, one), F.lit(0.0), lambda a, x: a + x))

    return once(given, rules)


def kind_bonus(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, bonus in KIND_BONUS.items():
        out = F.when(F.lower(kind) == name, bonus).otherwise(out)
    return out


def concept_hits(groups: Column, metadata: Column, content: Column) -> Column:
    return F.size(F.filter(groups, lambda g: F.exists(g, lambda t: T.matches_any(t, metadata) | T.matches_any(t, content))))


def relevance_factor(chunk: dict[str, Column], query: dict[str, Column]) -> Column:
    """1 and the bonuses; more with several concepts, less with none of name, path and concepts; 0.1 at least. chunk may have content_tokens instead of content, or the query's hits."""

    def found() -> Column:
        content = chunk["content_tokens"] if "content_tokens" in chunk else F.array_distinct(T.tokens(chunk["content"]))
        return concept_hits(query["groups"], T.metadata_tokens(chunk["file_path"], chunk["kind"], chunk["name"], chunk["language"]), content)

    given = F.struct(
        name_bonus(chunk["name"], query["search_text"], query["compact"], query["word_compacts"], query["raw_terms"]).alias("name"),
        path_bonus(chunk["file_path"], query["base_terms"]).alias("path"),
        (chunk["hits"] if "hits" in chunk else found()).alias("hits"),
    )

    def rules(x: Column) -> Column:
        factor = F.lit(1.0) + x["name"] + x["path"] + kind_bonus(chunk["kind"])
        lone = (F.size(query["groups"]) > 1) & (x["name"] == 0.0) & (x["path"] == 0.0)
        return F.greatest(F.lit(0.1), F.when(x["hits"] > 1, factor + F.least(x["hits"], F.lit(5)) * F.lit(0.12)).when(lone, factor * F.lit(0.75)).otherwise(factor))

    return F.when((F.size(query["base_terms"]) == 0) & (F.size(query["content_terms"]) == 0), 1.0).otherwise(once(given, rules))


def first_line(content: Column) -> Column:
    """The first line that isn't blank, in lower case, without what stands blank before it."""
    return F.lower(F.coalesce(F.try_element_at(F.split(F.regexp_replace(content, f"^{SPACE}+", ""), LINE_ENDS, 2), F.lit(1)), F.lit("")))


def definition_bonus(content: Column, terms: Column) -> Column:
    return once(first_line(content), lambda line: F.least(F.lit(0.8), F.lit(0.2) * F.size(F.filter(terms, lambda t: F.contains(line, t)))))


def symbol_score(chunk: dict[str, Column], query: dict[str, Column]) -> Column:
    """0 unless the name gives a bonus."""
    bonus = name_bonus(chunk["name"], query["search_text"], query["compact"], query["word_compacts"], query["raw_terms"])
    factor = F.when(F.lower(chunk["kind"]).isin(*DEFINITIONS), 1.2).otherwise(0.7)
    return once(bonus, lambda b: F.when(b > 0, (b + definition_bonus(chunk["content"], query["raw_terms"])) * factor).otherwise(0.0))


def passes_filters(chunk: dict[str, Column], query: dict[str, Column]) -> Column:
    """Any of the values of each filter that is given: kind and language equal, path and name contain."""
    given = lambda f, test: (F.size(query[f]) == 0) | test
    low = lambda c: F.lower(F.coalesce(chunk[c], F.lit("")))
    part = lambda f, c: F.exists(query[f], lambda x: F.contains(c, x))
    return (
        given("kinds", F.array_contains(query["kinds"], low("kind"))) & given("languages", F.array_contains(query["languages"], low("language")))
        & given("paths", part("paths", F.lower(T.slashes(chunk["file_path"])))) & given("names", part("names", low("name")))
    )
