"""Suffix-array dedup over prefix-free parsing: bytes in strings that stand more than once in the corpus.

A rolling hash over 8 bytes makes triggers: where it is least within REACH places either way. The window that decides on a
trigger, WINDOW bytes, is what two phrases share: a phrase goes from one window's start to the next one's end. Equal text
is parsed equally, and no phrase's suffix of more than a window begins another one. A block of documents is parsed into its
dictionary (the distinct phrases) and its parse (their sequence), and both are put in suffix order:

- the dictionary's suffixes by their bytes, so that phrases and suffixes have ranks in the alphabet's order;
- the parse's suffixes by their phrases' ranks, by prefix doubling.

A place in the text has the rank of the dictionary suffix that starts there and that of the parse's suffix after it. In
the order of these two, strings of equal bytes are neighbours: that is the block's order, and it tells which strings the
block has, exactly. Over all blocks, buckets merge them in the order of fingerprints, as from there on it only matters
what is equal. So that few strings have to be merged, the dictionary and the parse are merged first:

- a string that holds a phrase of which there is one only is unique;
- a parse suffix, cut where it has covered a string's length beyond its first phrase, tells of all strings that start in
  that phrase: if the cut suffix stands twice, all of them do. One key stands for a whole phrase's strings.

What neither decides lies at the ends of repeats: there the strings themselves are merged, against one occurrence of each
repeated parse suffix. A fingerprint is 64 bits of one hash, by which it is dealt and sorted, and 31 of another of a
different kind, by which equal ones are checked. Both draw their constants anew for each run.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.blocks import SENT, arrow_type, block_docs, block_table, bucket_count, dealt, mixed, packed, per_block, per_block_with, sent_batch, sorted_packed, sorted_unpacked, text_bytes, unpacked
from quarry.llm.common import written

#: A string's bytes; those of a trigger; how far around a trigger's hash is the least; what decides on a trigger.
LENGTH, TRIGGER, REACH = 200, 8, 20
WINDOW = REACH + TRIGGER + REACH
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The second hash is taken modulo this prime.
PRIME = np.uint64((1 << 31) - 1)
PHRASES, CONTEXTS, STRINGS = 0, 1, 2
#: A block's texts; several numbers are held for each byte.
BLOCK_BYTES = 2 << 20


@functools.lru_cache(1)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a seed: the letters' numbers, the powers of a multiplier and their inverses modulo 2**64, and the same of another modulo PRIME."""
    letters = mixed(np.arange(1, 257, dtype=np.uint64), seed)
    base = int(mixed(np.array([seed], np.uint64), 5)[0]) | 1
    up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    small = int(mixed(np.array([seed], np.uint64), 6)[0]) % (int(PRIME) - 1000) + 500

    def powers(x: int) -> np.ndarray:
        out, have = np.ones(n, np.uint32), 1
        while have < n:
            step = min(have, n - have)
            out[have : have + step] = out[:step].astype(np.uint64) * np.uint64(pow(x, have, int(PRIME))) % PRIME
            have += step
        return out

    return letters, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), powers(small), powers(pow(small, -1, int(PRIME)))


class Fingerprints:
    """Of any substring, from sums of its letters times powers, two hashes that don't depend on where it stands. bits: how many the first one has."""

    def __init__(self, flat: np.ndarray, seed: int, bits: int = 64) -> None:
        n = 1 << max(16, int(len(flat) + 1).bit_length())
        letters, up, self.down, small, self.small_down = _powers(n, seed)
        self.mask = np.uint64(((1 << 64) - 1) ^ ((1 << (65 - bits)) - 1 | 1))
        self.sums, self.small = np.zeros(len(flat) + 1, np.uint64), np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(letters[flat] * up[: len(flat)], out=self.sums[1:])
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * small[: len(flat)] % PRIME, out=self.small[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        size = (b - a).astype(np.uint64) + np.uint64(1 << 40) * np.asarray(salt, np.uint64)
        first = mixed((self.sums[b] - self.sums[a]) * self.down[a] + size * MULTIPLIER) & self.mask
        second = (self.small[b] - self.small[a]) % PRIME * self.small_down[a] + size
        return first, (second % PRIME).astype(np.uint32)


class Parse(NamedTuple):
    start: np.ndarray  # of each phrase: its first trigger window's, or the document's
    next: np.ndarray  # where the next phrase or document starts
    end: np.ndarray  # of the phrase, with the window that it shares with the next
    first: np.ndarray  # whether it starts its document
    doc_end: np.ndarray


def ranks(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The substrings' places in the alphabet's order, by LENGTH bytes at most; equal ones have equal places, and what begins another comes first.

    Eight bytes at a time; only what is not told apart yet goes on.
    """
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    words = np.ndarray((len(flat) + 1,), ">u8", padded.data, strides=(1,))
    size = np.minimum(end - start, LENGTH)
    rank = np.zeros(len(start), np.int64)
    tied = np.arange(len(start))
    for at in range(0, LENGTH, 8):
        left = np.clip(size[tied] - at, 0, 8)
        word = words[np.minimum(start[tied] + at, len(flat))].astype(np.uint64)
        gone = ((8 - left) * 8).astype(np.uint64)
        word = np.where(left > 0, word >> np.minimum(gone, np.uint64(63)) << np.minimum(gone, np.uint64(63)), 0)
        order = np.lexsort((left, word, rank[tied]))
        tied, word, left = tied[order], word[order], left[order]
        old = rank[tied]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], (word[1:] != word[:-1]) | (left[1:] != left[:-1])])
        index = np.arange(len(tied))
        rank[tied] = old + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(new_old, index, 0))
        several = ~(new & np.concatenate([new[1:], [True]])) & (left == 8)
        tied = tied[several]
        if not len(tied):
            break
    return rank


def parse_ranks(rank: np.ndarray, p: Parse) -> np.ndarray:
    """The suffix order of the parse, by as many phrases as a string may reach into: prefix doubling over the phrases' ranks. A place more, of rank 0, for what is behind the last."""
    n = len(rank)
    out = np.append(rank + 1, 0)
    doc = np.append(np.cumsum(p.first), 0)
    step = 1
    while step * (REACH + 1) < LENGTH:  # triggers are REACH + 1 places apart at least
        after = np.minimum(np.arange(n) + step, n)
        follow = np.where(doc[after] == doc[:n], out[after], 0)
        _, back = np.unique(out[:n] * (int(out.max(initial=0)) + 1) + follow, return_inverse=True)
        out = np.append(back + 1, 0)
        step *= 2
    return out


def triggers(flat: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """The places whose hash is less than those of the REACH places before in the document, and at most those of the REACH after."""
    n, none = len(flat), np.uint32(0xFFFFFFFF)
    if n < TRIGGER:
        return np.zeros(0, np.int64)
    at = np.ndarray((n - TRIGGER + 1,), "<u8", np.ascontiguousarray(flat).data, strides=(1,))
    hashes = np.full(n, none, np.uint32)
    hashes[: len(at)] = (at * MULTIPLIER) >> np.uint64(32)
    tail = (doc_ends[:, None] - np.arange(1, TRIGGER)).ravel()
    hashes[np.maximum(tail, np.repeat(doc_starts, TRIGGER - 1))] = none  # these would reach into the next document
    # documents stand REACH and more apart
    place = np.arange(n) + np.repeat(np.arange(1, len(doc_starts) + 1) * 2 * REACH, doc_ends - doc_starts)
    apart = np.full(n + (len(doc_starts) + 2) * 2 * REACH, none, np.uint32)
    apart[place] = hashes
    least, width = apart, 1
    while width < REACH:  # of so many places from each on
        step = min(width, REACH - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return np.flatnonzero((hashes < least[place - REACH]) & (hashes <= least[place + 1]) & (hashes != none))


def parse(flat: np.ndarray, starts: np.ndarray) -> Parse:
    """The phrases of documents that stand after one another; starts: of each, and the end. Empty documents have none. Windows that a document's end cuts are none."""
    n = len(flat)
    doc_starts = np.unique(starts[:-1][starts[1:] > starts[:-1]])
    doc_ends = np.append(doc_starts[1:], n)[: len(doc_starts)]
    windows = triggers(flat, doc_starts, doc_ends) - REACH
    doc = np.searchsorted(doc_starts, windows + REACH, "right") - 1
    windows = windows[(windows > doc_starts[doc]) & (windows + WINDOW <= doc_ends[doc])]
    start = np.union1d(doc_starts, windows)
    doc = np.searchsorted(doc_starts, start, "right") - 1
    following = np.append(start[1:], n)[: len(start)]
    return Parse(start, following, np.minimum(following + WINDOW, doc_ends[doc]), np.isin(start, doc_starts, assume_unique=True), doc_ends[doc])


def contexts(p: Parse) -> tuple[np.ndarray, np.ndarray]:
    """The phrases in which strings start, and where each one's cut parse suffix ends."""
    has = p.start + LENGTH <= p.doc_end
    need = p.next[has] + LENGTH - 1
    to = np.searchsorted(p.end, need)
    return np.flatnonzero(has), np.minimum(p.end[np.minimum(to, len(p.end) - 1)], p.doc_end[has])


class Keys(NamedTuple):
    """Distinct fingerprints in order; of the first hash, the lowest bit says whether several places have them."""

    keys: np.ndarray
    checks: np.ndarray
    first: np.ndarray  # where each stands first
    back: np.ndarray  # of each place, which it has


def keyed(keys: np.ndarray, checks: np.ndarray, many: np.ndarray | None = None) -> Keys:
    """many: which places stand for several."""
    order = np.argsort(keys, kind="stable")
    a, b = keys[order], checks[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):  # hardly ever: the second hash has to tell them apart
        order = np.lexsort((checks, keys))
        a, b = keys[order], checks[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    several = np.diff(np.append(at, len(a))) > 1
    if many is not None:
        several |= np.bincount(back, many, len(at)) > 0
    return Keys(a[at] | several.astype(np.uint64), b[at], order[at], back)


def _send(block: int, kind: int, k: Keys, buckets: int) -> list[tuple]:
    return [(block, bucket, kind, sorted_packed(k.keys[part]), packed(k.checks[part])) for bucket, part in dealt(k.keys, buckets)]


class Block:
    """A block's dictionary, parse and keys."""

    def __init__(self, docs: bytes, seed: int, bits: int = 64) -> None:
        self.keys, text = block_docs(docs)
        self.flat, self.starts = text_bytes(text)
        self.parse = p = parse(self.flat, self.starts)
        self.prints = Fingerprints(self.flat, seed, bits)
        inner = np.flatnonzero(~p.first & (p.end == p.next + WINDOW) & (p.end - p.start <= LENGTH))  # between two windows, and a string can hold it
        self.phrase_start, self.phrase_end = p.start[inner], p.end[inner]
        self.phrases = keyed(*self.prints(self.phrase_start, self.phrase_end))
        self.context, to = contexts(p)
        # the first phrase's length is part of the key: one occurrence then has all the strings of the others
        self.contexts = keyed(*self.prints(p.start[self.context], to, (p.next - p.start)[self.context]))

    def decided(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """By phrases and parse suffixes: the places whose strings are repeated, and those whose strings are to be compared (the undecided, and one occurrence of each repeated suffix)."""
        p, n = self.parse, len(self.flat)
        phrase, context = answer(answers, PHRASES), answer(answers, CONTEXTS)
        edges = np.zeros(n + 1, np.int32)
        alone = phrase[self.phrases.back] & 1 == 0
        start, end = self.phrase_start[alone], self.phrase_end[alone]
        low, high = np.maximum(end - LENGTH, self.starts[np.searchsorted(self.starts, start, "right") - 1]), start + 1
        edges += np.bincount(low, minlength=n + 1).astype(np.int32) - np.bincount(high, minlength=n + 1).astype(np.int32)
        unique = np.cumsum(edges[:n]) > 0
        # all places in a phrase share its suffix's answer: bit 0 repeated, bit 1 to be compared for the others
        state = np.zeros(len(p.start), np.uint8)
        repeated = context[self.contexts.back] & 1 > 0
        state[self.context] = 4 + repeated
        donor = self.contexts.first[context & 2 > 0]
        state[self.context[donor]] |= 2
        spread = np.repeat(state, p.next - p.start)
        last = np.repeat(p.doc_end, p.next - p.start) - LENGTH
        fits = (spread & 4 > 0) & (np.arange(n) <= last)
        known = fits & (spread & 1 > 0)
        return known, fits & ~unique & (~known | (spread & 2 > 0))

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in the block's suffix order, and whether each one's string differs from that of the place before it."""
        p = self.parse
        rank = ranks(self.flat, p.start, p.end)  # of the dictionary's phrases
        follow = parse_ranks(rank, p)
        phrase = np.searchsorted(p.start, at, "right") - 1
        # the dictionary's suffixes that start at the places, each once
        offset = at - p.start[phrase]
        same, long, known = rank.copy(), np.flatnonzero(p.end - p.start > LENGTH), {}
        for i in long.tolist():  # of these, ranks look at the first LENGTH bytes only
            same[i] = len(rank) + known.setdefault(self.flat[p.start[i] : p.end[i]].tobytes(), len(known))
        _, one, back = np.unique(same[phrase] * (int(offset.max(initial=0)) + 1) + offset, return_index=True, return_inverse=True)
        suffix = ranks(self.flat, at[one], p.end[phrase[one]])[back]
        after = follow[np.where(p.end[phrase] < p.doc_end[phrase], phrase + 1, len(rank))]
        order = np.lexsort((after, suffix))
        a, b = at[order[:-1]], at[order[1:]]
        same = suffix[order[1:]] == suffix[order[:-1]]
        look = np.flatnonzero(same & (after[order[1:]] != after[order[:-1]]))  # the phrases after may differ beyond the strings' ends
        words = np.ndarray((max(0, len(self.flat) - 7),), "<u8", np.ascontiguousarray(self.flat).data, strides=(1,))
        for step in range(LENGTH - 8, -1, -8):
            equal = words[a[look] + step] == words[b[look] + step]
            same[look[~equal]] = False
            look = look[equal]
        return order, np.concatenate([[True], ~same])[: len(order)]

    def strings(self, compare: np.ndarray) -> tuple[Keys, np.ndarray, np.ndarray]:
        """The keys of the distinct strings to be compared, the places, and which key each has."""
        at = np.flatnonzero(compare)
        order, new = self.order(at)
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        one = at[order[new]]
        found = keyed(*self.prints(one, one + LENGTH), np.bincount(group, minlength=len(one)) > 1)
        return found, at, found.back[group]


    def repeated(self, compare: np.ndarray, answers: np.ndarray) -> np.ndarray:
        """The compared places whose strings are repeated; answers: to the keys of strings(), in their order.

        A string's key is its fingerprint, so a place finds its key by that; the order need not be made again.
        """
        at = np.flatnonzero(compare)
        return at[answers[keyed(*self.prints(at, at + LENGTH)).back] & 1 > 0]


def answer(rows: list[dict], kind: int) -> np.ndarray:
    """The answers to the keys of a kind, in the keys' order."""
    parts = [unpacked(r["keys"], "u1") for r in rows if r["kind"] == kind]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def compare_keys(table: pa.Table) -> pa.Table:
    """A bucket's keys from all blocks, put in order. Each block's answer: bit 0 for a key that stands twice or more, bit 1 as well where it is the first of them."""
    rows = sorted(table.select(["block", "bucket", "kind", "keys", "checks"]).to_pylist(), key=lambda r: r["block"])
    parts = [sorted_unpacked(r["keys"]) for r in rows]
    keys, checks = np.concatenate(parts), np.concatenate([unpacked(r["checks"], "<u4") for r in rows])
    k = keyed(keys & ~np.uint64(1), checks, keys & np.uint64(1) > 0)
    bits = (k.keys & np.uint64(1)).astype(np.uint8)[k.back]
    bits[k.first] *= 3
    ends = np.cumsum([len(x) for x in parts])
    return pa.Table.from_batches([sent_batch([(r["block"], r["bucket"], r["kind"], packed(bits[e - len(x) : e]), b"") for r, x, e in zip(rows, parts, ends)])])


def _sent_schema() -> pa.Schema:
    return sent_batch([]).schema


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of a string of 200 bytes that starts at another place of the corpus as well, the same document
    included, overlaps too. Strings lie within a document and are judged on the input. A null text is empty; documents
    of under 200 bytes keep all. Equal rows give equal results, all removed if they are long enough. Whole texts are
    parsed, in blocks; an empty table gives no rows; other columns don't matter. Strings of different blocks are the same
    if both their hashes are; bits: how many bits the first one has (few of them leave the decision to the second).
    """
    blocks = block_table(docs, key, text, block_bytes)
    buckets = bucket_count(blocks)
    kind, seed = docs.schema[key].dataType.simpleString(), secrets.randbits(62)

    def first(block: int, held: bytes) -> pa.RecordBatch:
        b = Block(held, seed, bits)
        return sent_batch(_send(block, PHRASES, b.phrases, buckets) + _send(block, CONTEXTS, b.contexts, buckets))

    def second(block: int, held: bytes, answers: list[dict]) -> pa.RecordBatch:
        b = Block(held, seed, bits)
        return sent_batch(_send(block, STRINGS, b.strings(b.decided(answers)[1])[0], buckets))

    def last(block: int, held: bytes, answers: list[dict]) -> pa.RecordBatch:
        b = Block(held, seed, bits)
        known, compare = b.decided(answers)
        found = b.repeated(compare, answer(answers, STRINGS))
        n = len(b.flat)
        edges = np.zeros(n + 1, np.int32)
        edges[:n] += known
        edges[found] = 1
        up = np.flatnonzero(edges)
        edges = np.bincount(up, minlength=n + 1) - np.bincount(up + LENGTH, minlength=n + 1)
        gone = np.cumsum(edges[:n]) > 0
        raw, rows = b.flat.tobytes(), []
        runs = gone.copy()
        runs[1:] &= ~gone[:-1]
        inside = b.starts[:-1][b.starts[1:] > b.starts[:-1]]
        runs[inside] = gone[inside]
        totals, run_totals = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(runs)])
        for s, e in zip(b.starts[:-1].tolist(), b.starts[1:].tolist()):
            removed = int(totals[e] - totals[s])
            kept = raw[s:e] if not removed else b.flat[s:e][~gone[s:e]].tobytes() if removed < e - s else b""
            rows.append((e - s, removed, int(run_totals[e] - run_totals[s]), hashlib.sha256(kept).hexdigest()))
        size, removed, spans, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([b.keys, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    shape = pa.schema([("doc_id", arrow_type(docs, key)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    by = ["bucket", "kind"]
    parsed = written(per_block(blocks, first, SENT).groupBy(*by).applyInArrow(compare_keys, SENT), "parse")
    sent = per_block_with(blocks, parsed, second, SENT, _sent_schema())
    strings = sent.groupBy(*by).applyInArrow(compare_keys, SENT)
    return per_block_with(blocks, parsed.unionByName(strings), last, out, shape)
