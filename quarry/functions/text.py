"""Text functions as columns; regular expressions are Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.terms import CAMEL, TOKEN



def split_token(token: Column) -> Column:
    """terms.split_token(); most tokens are plain words, and stay whole without a search for parts."""
    whole = F.lower(token)
    parts = F.when(F.contains(token, F.lit("_")), F.filter(F.split(whole, "_"), lambda x: x != "")).otherwise(F.transform(F.regexp_extract_all(token, F.lit(CAMEL), 0), F.lower))
    # one step by transform(), so that the parts are computed once
    cut = F.transform(F.array(F.struct(whole.alias("w"), parts.alias("p"))), lambda x: F.when(F.size(x["p"]) > 1, F.concat(F.array(x["w"]), x["p"])).otherwise(F.array(x["w"])))[0]
    return F.when(F.rlike(token, F.lit("^[A-Za-z][a-z]*$")), F.array(whole)).otherwise(cut)


def tokens(text: Column) -> Column:
    """All tokens in order, repeated ones too."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), split_token))


def stem_variants(term: Column) -> Column:
    """terms.stems() of a term in lower case."""
    n = F.length(term)
    cut = lambda k: F.substring(term, F.lit(1), n - k)
    ends = lambda s: F.endswith(term, F.lit(s))
    at = lambda k: F.substring(term, -k, 1)
    none = F.lit(None).cast("array<string>")

    def without(k: int) -> Column:
        base = cut(k)
        return F.concat(F.array(base, F.concat(base, F.lit("e"))), F.when((n > k + 1) & (at(k + 1) == at(k + 2)), F.array(cut(k + 1))).otherwise(F.array().cast("array<string>")))

    y = lambda k: F.concat(cut(k), F.lit("y"))
    rules = [
        F.when(ends("ing") & (n > 5), without(3)),
        F.when((ends("tion") | ends("sion")) & (n > 5), F.array(cut(3))),
        F.when(ends("ment") & (n > 6), F.array(cut(4))),
        F.when(n > 4, F.when(ends("ies"), F.array(y(3))).when(ends("es"), F.when(at(3).isin("s", "x", "z"), F.array(cut(2))).otherwise(F.array(cut(2), cut(1)))).when(ends("s") & ~ends("ss"), F.array(cut(1)))),
        F.when((n > 4) & ends("ed") & ~ends("eed"), F.array(cut(1), cut(2))),
        F.when((n > 5) & ends("ied"), F.array(y(3))),
        F.when((n > 4) & ends("er"), without(2)),
    ]
    found = F.flatten(F.array_compact(F.array(*(F.coalesce(r, none) for r in rules))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & (x != term))))


def with_stems(given: Column) -> Column:
    """Each token once, followed by its stems, in order."""
    return F.array_distinct(F.flatten(F.transform(given, lambda t: F.concat(F.array(t), stem_variants(t)))))


def name_tokens(name: Column) -> Column:
    return with_stems(tokens(F.coalesce(name, F.lit(""))))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def file_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), F.lit(""))


def stem(name: Column) -> Column:
    """A file's name up to its last dot, unless that is the first or last letter."""
    return F.regexp_replace(name, r"^((?s:.+))\.[^.]+$", "$1")


def dirs(path: Column) -> Column:
    parts = path_parts(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def path_text(path: Column) -> Column:
    """The file's name, its stem and its directories."""
    p = slashes(path)
    return F.concat_ws(" ", file_name(p), stem(file_name(p)), F.concat_ws(" ", dirs(p)))


def path_tokens(path: Column) -> Column:
    """Tokens of the file's name, its stem and its directories, with stems."""
    return with_stems(tokens(path_text(path)))


def metadata_text(path: Column, kind: Column, name: Column, language: Column) -> Column:
    return F.concat_ws(" ", path, stem(file_name(path)), F.concat_ws("/", dirs(path)), kind, name, language)


def metadata_tokens(path: Column, kind: Column, name: Column, language: Column) -> Column:
    return F.array_distinct(tokens(metadata_text(path, kind, name, language)))


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9_]+", ""))


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def enriched(content: Column, path: Column, kind: Column, name: Column, language: Column) -> Column:
    """The content with its file's stem twice, the last three directories, kind, name and language."""
    s, d = stem(file_name(path)), dirs(path)
    last = F.concat_ws(" ", F.slice(d, F.greatest(F.lit(1), F.size(d) - 2), F.lit(3)))
    given = lambda c: F.when(c != "", c)
    return F.concat(content, F.lit(" "), s, F.lit(" "), s, F.lit(" "), last, F.lit(" "), F.concat_ws(" ", given(kind), given(name), given(language)))


def embedding_text(content: Column, path: Column, kind: Column, name: Column, language: Column) -> Column:
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.concat(F.lit("path: "), path), F.concat(F.lit("kind: "), kind), line("name: ", name), line("language: ", language), F.lit(""), content)


def matches_any(term: Column, candidates: Column) -> Column:
    """Whether a candidate is the term, or one is the other's beginning and at least three letters long."""
    begins = lambda a, b: (F.length(a) > 2) & F.startswith(b, a)
    return F.exists(candidates, lambda c: (c == term) | begins(c, term) | begins(term, c))
