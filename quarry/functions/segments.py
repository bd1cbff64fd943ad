"""Tokens of many texts at once, in a worker: the bytes of a batch are cut by their classes, and only its different words are looked at one by one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from quarry.functions.terms import split_token

#: Bytes of text that are cut at once; several numbers are held for each token.
SLICE_BYTES = 1 << 20
#: Different words whose tokens a worker remembers.
REMEMBERED = 1 << 16
#: Words that terms.split_token() leaves whole.
WHOLE = "^[A-Za-z][a-z]*$"
#: Of each byte: 2 may begin a token (terms.TOKEN), 1 may stand in one.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(48, 58)]] = 1
_CLASS[[*range(65, 91), 95, *range(97, 123)]] = 2


class Segment(NamedTuple):
    """words: all different tokens, sorted. text and word: of each token, its text's number and its word's."""

    words: pa.Array
    text: np.ndarray
    word: np.ndarray


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Where parts of the texts of about SLICE_BYTES each start and end."""
    offsets = np.frombuffer(text.cast(pa.large_binary()).buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()  # workers stay, and an executor has several


def raw_tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What terms.TOKEN finds, and the number of the text of each. A null text has none."""
    held = text.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    starts = offsets[:-1] - offsets[0]
    kind = _CLASS[flat]
    word = kind > 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = starts[starts < len(flat)]
    first[inside] = word[inside]  # a text's end ends a word
    inside = inside[inside > 0] - 1
    last[inside] = word[inside]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    digit = np.flatnonzero(kind[begin] == 1)  # what begins with digits is a token from its first letter on, if it has one
    if len(digit):
        letters = np.append(np.flatnonzero(kind == 2), len(flat))
        to = np.minimum(letters[np.searchsorted(letters, begin[digit])], end[digit])
        gone = np.zeros(len(flat) + 1, np.int8)
        gone[begin[digit]] += 1
        np.subtract.at(gone, to, 1)
        word &= np.cumsum(gone[:-1], dtype=np.int8) == 0
        begin[digit] = to
        some = end > begin
        begin, end = begin[some], end[some]
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat[word]))
    return found, np.searchsorted(starts, begin, "right") - 1


def segment(text: pa.Array, split: Callable[[str], list[str]], known: dict[str, list[str]]) -> Segment:
    """The tokens that split() gives for each of the texts' raw ones, in any order. known: what it gave so far.

    split_token() leaves most words whole; these aren't looked at one by one.
    """
    found, number = raw_tokens(text)
    coded = found.dictionary_encode()
    raw, index = coded.dictionary, np.asarray(coded.indices, np.int64)
    whole = np.asarray(pc.match_substring_regex(raw, WHOLE)) if split is split_token else np.zeros(len(raw), bool)
    if len(known) > REMEMBERED:
        known.clear()
    parts = []
    for x in raw.filter(pa.array(~whole)).to_pylist():
        if (p := known.get(x)) is None:
            known[x] = p = split(x)
        parts.append(p)
    size, at = np.ones(len(raw), np.int64), np.empty(len(raw), np.int64)
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    size[~whole] = many
    at[whole] = np.arange(int(whole.sum()))
    at[~whole] = int(whole.sum()) + np.cumsum(many) - many
    every = pa.concat_arrays([pc.ascii_lower(raw.filter(pa.array(whole))), pa.array([x for p in parts for x in p], pa.large_string())]).dictionary_encode()
    order = np.asarray(pc.array_sort_indices(every.dictionary), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, count = place[np.asarray(every.indices, np.int64)], size[index]
    each = np.repeat(at[index] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return Segment(every.dictionary.take(pa.array(order)).cast(pa.string()), np.repeat(number, count), codes[each])


def first_words(text: pa.Array, leave_out: list[str], most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different raw tokens of two letters or more, without those that are left out whatever their case: the first so many of each text, in order. Words, each one's text's number and its word's."""
    found, number = raw_tokens(text)
    coded = found.dictionary_encode()
    words, index = coded.dictionary, np.asarray(coded.indices, np.int64)
    good = np.asarray(pc.and_(pc.greater(pc.binary_length(words), 1), pc.invert(pc.is_in(pc.ascii_lower(words), pa.array(leave_out, words.type)))))
    number, index = number[good[index]], index[good[index]]
    _, first = np.unique(number * max(1, len(words)) + index, return_index=True)
    first.sort()
    number, index = number[first], index[first]
    nth = np.arange(len(number)) - np.searchsorted(number, number)
    return words.cast(pa.string()), number[nth < most], index[nth < most]


def matching(words: list[str], terms: list[str]) -> np.ndarray:
    """Which of the sorted words text.matches_any() holds one of the terms to match."""
    out = np.zeros(len(words), bool)
    for t in terms:
        ends = t + "\x7f" if len(t) > 2 else t + "\0"  # tokens are ASCII letters, digits and underscores
        out[bisect_left(words, t) : bisect_left(words, ends)] = True
        for n in range(3, len(t)):
            if (i := bisect_left(words, t[:n])) < len(words) and words[i] == t[:n]:
                out[i] = True
    return out


def with_hits(rows: DataFrame, text: Column) -> DataFrame:
    """rows without content, and `hits`: how many of the query's groups have a term that matches a token of the text. rows: query_id, groups, content."""
    given = rows.withColumn("hits", text).drop("content")
    at, who, what = (given.columns.index(x) for x in ("hits", "query_id", "groups"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            ids, hits = np.asarray(batch.column(who)), np.zeros(batch.num_rows, np.int32)
            for start, end in slices(batch.column(at)):
                found = segment(batch.column(at).slice(start, end - start), split_token, known)
                words = found.words.to_pylist()
                for query, first in zip(*np.unique(ids[start:end], return_index=True)):
                    groups = [matching(words, g) for g in batch.column(what)[start + int(first)].as_py() or []]
                    if not groups:
                        continue
                    mine = ids[start:end] == query
                    some = np.logical_or.reduce(groups)[found.word] & mine[found.text]
                    word, number = found.word[some], found.text[some]
                    for g in groups:
                        has = np.zeros(end - start, bool)
                        has[number[g[word]]] = True
                        hits[start:end] += has
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(hits), *batch.columns[at + 1 :]], batch.schema.names)

    return given.mapInArrow(run, T.StructType([T.StructField(f.name, T.IntegerType() if f.name == "hits" else f.dataType) for f in given.schema]))
