"""Quality rules: repetition in a document, by suffix arrays over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import batches, word_lists

#: Rules of the base verdict.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
#: Rules of the suffix-array verdict: repeats of so many words count; of the words, at most this share in them; the longest at most so many words.
REPEAT_WORDS, MOST_COVERED, LONGEST_REPEAT = 6, 0.4, 200
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def suffix_order(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all documents' words (documents in order, suffixes end with their document), and for each k the rank of each suffix by its first 2**k words.

    Prefix doubling; each round sorts only suffixes whose rank isn't theirs alone yet.
    """
    n = len(word)
    _, first, rank, size = np.unique(doc * (int(word.max(initial=0)) + 1) + word, return_index=True, return_inverse=True, return_counts=True)
    starts = np.cumsum(size) - size
    rank, alone = starts[rank], (size == 1)[rank]
    levels, step = [rank], 1
    tied = np.flatnonzero(~alone)
    while len(tied):
        after = tied + step
        inside = after < n
        next_rank = np.zeros(len(tied), np.int64)
        at = after[inside]
        next_rank[inside] = np.where(doc[at] == doc[tied[inside]], rank[at] + 1, 0)
        key = rank[tied] * (n + 1) + next_rank
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old = rank[tied]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        index = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(new_key, index, 0)) - np.maximum.accumulate(np.where(new_old, index, 0))
        ends = np.concatenate([new_key[1:], [True]])
        tied = np.sort(tied[~(new_key & ends)])
        levels.append(rank)
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, levels


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The longest common prefix, in words, of each suffix with the one before it in the suffix array."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, length = sa[at - 1].copy(), sa[at].copy(), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        length += same << k
        a, b = a + (same << k), b + (same << k)
    lcp[at] = length
    return lcp


def longest_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each position, the most words that start there and also at another position of the document: the depth of its deepest LCP interval."""
    if not len(word):
        return np.zeros(0, np.int64)
    sa, levels = suffix_order(doc, word)
    lcp = neighbour_lcp(sa, levels)
    out = np.empty(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Whether each word is in a repeated substring of so many words: the union of all intervals' spans."""
    start = np.flatnonzero(longest >= least)
    edge = np.bincount(start, minlength=len(longest) + 1) - np.bincount(start + longest[start], minlength=len(longest) + 1)
    return np.cumsum(edge)[: len(longest)] > 0


def dup_lines(text: bytes) -> int:
    """Lines that have a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(batch: pa.RecordBatch, text: str = "text") -> dict[str, np.ndarray]:
    words, counts = word_lists(batch, text)
    rows = batch.num_rows
    doc = np.repeat(np.arange(rows), counts)
    ids = np.asarray(words.dictionary_encode().indices, np.int64) if len(words) else np.zeros(0, np.int64)
    longest = longest_repeats(doc, ids)

    def per_row(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, rows).astype(np.int64)

    whole = pc.fill_null(batch.column(text), "")
    out = {"n_words": counts, "word_chars": per_row(np.asarray(pc.utf8_length(words), np.int64)), "n_symbols": np.asarray(pc.count_substring_regex(whole, "[#*$%&|<>]"), np.int64)}
    out["n_dup_lines"] = np.array([dup_lines(x) for x in whole.cast(pa.binary()).to_pylist()], np.int64)
    out["n_repeat_words"] = per_row(covered(longest, WINDOW))
    out["n_covered_words"] = per_row(covered(longest, REPEAT_WORDS))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, doc, longest)
    out["longest_repeat"] = most
    out["base_failed"] = (counts < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * counts)
    out["kept"] = ~out["base_failed"] & (out["n_covered_words"] <= MOST_COVERED * counts) & (most <= LONGEST_REPEAT)
    return out


def score(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: the columns to keep and COLUMNS.

    Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as empty; an empty one has no words and fails. Repeats are found
    within a document only, whole texts at a time; a word that is very long counts as one. Repeated rows give repeated
    results; an empty table gives none. Columns beside those to keep don't matter, whatever their names.
    """
    kept = docs.select(*dict.fromkeys([*keep, text]))
    fields = [f for f in kept.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + COLUMNS

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given, text):
            found = measure(batch, text)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(x) for x in found.values()], [f.name for f in fields] + list(found))

    return kept.mapInArrow(run, schema)


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns, whatever these are. Null and empty texts have no words and go; repeated rows are judged alike; an empty table stays empty."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given, text):
            yield batch.filter(pa.array(measure(batch, text)["kept"]))

    return docs.mapInArrow(run, docs.schema)
