"""Bulk-synchronous best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import batches, written

CAPACITY, END = 1024, 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces are placed by classes of length, each this many times shorter than the one before.
CLASS = 4
#: From so few pieces and gaps on, the rounds that are left run in one task, with the same outcome.
FEW = 1 << 18
SLOT, DOC, PAIR = 0, 1, 2


#: Words whose ids a worker remembers, of so many letters at most.
REMEMBERED, LETTERS = 1 << 19, 64
#: New words that are given to the tokenizer as one text.
GROUP = 256
#: public_tokenizers.PATTERN, by which Encoder._cut() cuts plain texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of characters; equal ones of the first three stand in one word. A text with odd ones isn't plain.
LETTER, DIGIT, OTHER, WHITE, SPACE, ODD, UNSEEN = range(7)


def _kind(c: str) -> int:
    """Letters, decimal digits, marks, punctuation and symbols count if they have been that for long and still are."""
    if c in "\t\n\r ":
        return SPACE if c == " " else WHITE
    kind = unicodedata.category(c)
    good = (kind[0] in "LMPS" or kind == "Nd") and kind == unicodedata.ucd_3_2_0.category(c) and bool(re.match(r"[^\W\d_]", c)) == (kind[0] == "L")
    return {"L": LETTER, "N": DIGIT}.get(kind[0], OTHER) if good else ODD


def _room(held: np.ndarray, n: int) -> np.ndarray:
    return held if n <= len(held) else np.concatenate([held, np.zeros(max(n - len(held), len(held)), held.dtype)])


class Encoder:
    """The tokenizer of a file, asked for each different word once.

    A byte-level tokenizer cuts a text into words by a pattern and looks at each alone. So the ids of a text are its words'
    ids, and as words repeat, most needn't be found again. Whole batches are cut by the kinds of their characters. Texts with
    the tokenizer's own marks, or with letters of which Unicode's versions might differ in opinion, are given to it whole, as
    are all texts if it works in another way.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        cut = given.get("pre_tokenizer") or {}
        self.marks = [x["content"] for x in given["added_tokens"]]
        plain = not any(given.get(x) for x in ("normalizer", "post_processor", "truncation", "padding")) and not any(re.search(r"\s", x) for x in self.marks)
        self.by_word = plain and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True) and public_tokenizers.PATTERN == PATTERN
        vocabulary = self.own.get_vocab()
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a byte-level token has a letter for each byte
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))
        self.kind = np.full(0x110000, UNSEEN, np.uint8)
        #: Each word's number, in order; word n has the ids pool[edge[n] : edge[n + 1]]; again: it came in a later batch too.
        self.number: dict[str, int] = {}
        self.pool, self.edge, self.again = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def _cut(self, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of all texts after one another, where each text's begin, and which texts are one word as they aren't plain."""
        held = text.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        data = held.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        first = offsets - offsets[0]
        letters = str(flat.data, "utf-8")
        chars, at = flat, None
        if not letters.isascii():
            chars, at = np.frombuffer(letters.encode("utf-32-le"), "<u4"), np.flatnonzero((flat & 0xC0) != 0x80)
            first = np.searchsorted(at, first)
        del letters
        kind = self.kind[chars]
        if (kind == UNSEEN).any():
            for c in np.unique(chars[kind == UNSEEN]).tolist():
                self.kind[c] = _kind(chr(c))
            kind = self.kind[chars]
        odd = np.full(len(held), not self.by_word)
        odd[np.searchsorted(first, np.flatnonzero(kind == ODD), "right") - 1] = True
        raw = flat.tobytes() if self.marks else b""
        for mark in (x.encode() for x in self.marks if x):
            found = raw.find(mark)
            while found >= 0:
                number = int(np.searchsorted(offsets, offsets[0] + found, "right")) - 1
                odd[number] = True
                found = raw.find(mark, int(offsets[number + 1] - offsets[0]))
        n = len(chars)
        ends = np.zeros(n + 1, bool)
        ends[first] = True
        begin = ends[:-1].copy()
        white = kind >= WHITE
        # other kinds begin a word, but for a space's right neighbour; so does white space, of which the last goes with what follows or is alone
        begin[1:] |= np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
        begin[:-1] |= white[:-1] & ~white[1:] & ~ends[1:-1]
        mark = np.flatnonzero((chars == ord("'")) & begin)
        if len(mark):
            next1, next2 = (np.where(mark + k < n, chars[np.minimum(mark + k, n - 1)], 0) for k in (1, 2))
            next1[ends[np.minimum(mark + 1, n)]] = 0
            next2[ends[np.minimum(mark + 2, n)]] = 0
            one = np.isin(next1, [ord(x) for x in "stmd"])
            two = np.zeros(len(mark), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (next1 == ord(a)) & (next2 == ord(b))
            begin[mark[one | two] + 1] = False
            after = np.concatenate([mark[one] + 2, mark[two] + 3])
            begin[after[after < n]] = True
        for number in np.flatnonzero(odd):
            begin[first[number] + 1 : first[number + 1]] = False
        begins = np.flatnonzero(begin)
        edges = np.append(begins if at is None else at[begins], len(flat))
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat))
        return words, np.searchsorted(begins, first), odd

    def _joined(self, words: list[str], gap: str) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of words that stay apart with the gap behind each, and how many each word has; None if that can't be told."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        given = [gap.join([*words[i : i + GROUP], ""]) for i in range(0, len(words), GROUP)]
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in self.own.encode_batch_fast(given, add_special_tokens=False)])
        ends = np.cumsum(self.size[ids])
        want = np.cumsum(np.fromiter((len(x.encode()) for x in words), np.int64, len(words)) + len(gap))
        to = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or (ends[to] != want).any():
            return None
        count = np.diff(to, prepend=-1)
        if not gap:
            return ids, count
        return (np.delete(ids, to), count - 1) if (self.size[ids[to]] == len(gap)).all() else None

    def _found(self, words: list[str], alone: np.ndarray) -> np.ndarray:
        """Each word's number; the tokenizer is asked for new ones. alone: texts that it gets whole."""
        if len(self.number) > REMEMBERED:
            self._forget()
        out = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.again[out[out >= 0]] = True
        lone, spaced, others, long = [], [], [], []
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            (long if len(w) > LETTERS else lone if alone[i] or w.isspace() else spaced if w[0] == " " else others).append(i)
        for new, gap in ((spaced, ""), (others, "\n"), (lone, None), (long, None)):
            given = [words[i] for i in new]
            found = None if gap is None else self._joined(given, gap)
            if found is None:
                each = [np.asarray(x.ids, "<u4") for x in self.own.encode_batch_fast(given, add_special_tokens=False)]
                found = np.concatenate([np.zeros(0, "<u4"), *each]), np.fromiter(map(len, each), np.int64, len(each))
            ids, count = found
            n = len(self.number)
            self.edge, self.pool, self.again = _room(self.edge, n + len(new) + 1), _room(self.pool, int(self.edge[n]) + len(ids)), _room(self.again, n + len(new))
            self.edge[n + 1 : n + len(new) + 1] = self.edge[n] + np.cumsum(count)
            self.pool[self.edge[n] : self.edge[n] + len(ids)] = ids
            self.again[n : n + len(new)] = False
            out[new] = np.arange(n, n + len(new))
            if new is not long:  # these are held for this batch only
                self.number.update(zip(given, range(n, n + len(new))))
        return out

    def _forget(self) -> None:
        """Keeps the words that came again since the last time, unless these are most."""
        n = len(self.number)
        again = self.again[:n] if self.again[:n].sum() <= REMEMBERED // 2 else np.zeros(n, bool)
        count = np.diff(self.edge[: n + 1])
        self.number = {w: i for i, w in enumerate(itertools.compress(self.number, again.tolist()))}
        self.pool = self.pool[: self.edge[n]][np.repeat(again, count)]
        self.edge = np.concatenate([[0], np.cumsum(count[again])])
        self.again = np.zeros(len(self.number), bool)

    def __call__(self, text: pa.Array) -> list[np.ndarray]:
        if not len(text):
            return []
        words, first, odd = self._cut(text)
        coded = words.dictionary_encode()
        index = np.asarray(coded.indices, np.int64)
        alone = np.zeros(len(coded.dictionary), bool)
        alone[index[first[:-1][odd & (first[:-1] < first[1:])]]] = True
        each = self._found(coded.dictionary.to_pylist(), alone)[index]
        count = self.edge[each + 1] - self.edge[each]
        to = np.cumsum(count)
        ids = self.pool[np.repeat(self.edge[each] - (to - count), count) + np.arange(int(count.sum()))]
        return np.split(ids, np.concatenate([[0], to])[first[1:-1]])


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(given: Sequence[str] | pa.Array, path: str = TOKENIZER) -> list[np.ndarray]:
    """The ids of each text, as the tokenizer gives them without special tokens."""
    return _encoder(path)(given if isinstance(given, pa.Array) else pa.array(given, pa.string()))


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, item (the piece's own number): each document's ids and the end's id.

    A document that is longer than the capacity is cut so that all pieces but the first are full. A null text is empty, and
    so the end's id alone. Repeated rows give pieces each; an empty table gives none.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "item"]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 40
        for batch in batches(given, text):
            rows, out = [], []
            for row, found in enumerate(encode(batch.column(text), path)):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append(row)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), item))
                    item += 1
            columns = zip(zip(*out), (pa.int32(), *[pa.int64()] * 4))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), *(pa.array(x, t) for x, t in columns)], names)

    return docs.select(key, text).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, item long")


def matched(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The successor sweep over slots and pieces from large to small, slots first among equals: places of slots and of the pieces that they get.

    Each piece takes the smallest slot that is still free of those before it, the one that came last: slots and pieces
    match like opening and closing brackets. So they alternate on each level of depth.
    """
    depth = np.cumsum(np.where(slot, 1, -1))
    floor = np.minimum(np.minimum.accumulate(depth), 0) if len(slot) else depth
    alone = ~slot & (floor < np.concatenate([[0], floor[:-1]])) if len(slot) else ~slot
    level = depth - floor + ~slot
    at = np.flatnonzero(~alone)
    order = at[np.lexsort((at, level[at]))]
    pair = np.flatnonzero(slot[order[:-1]] & ~slot[order[1:]] & (level[order[:-1]] == level[order[1:]]))
    return order[pair], order[pair + 1]


def slots_of(gap: np.ndarray, top: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Which gap each slot is of, and the slots' sizes: a gap has as many slots as pieces of the length `top` surely go in, `each` at most; the last slot is the rest."""
    count = np.clip(gap // top, 1, each)
    of = np.repeat(np.arange(len(gap)), count)
    size = np.full(len(of), top, np.int64)
    size[np.cumsum(count) - 1] = gap - (count - 1) * top
    return of, size


def classes(capacity: int) -> list[tuple[int, int]]:
    """(low, top) of the classes of lengths over low, up to top. Pieces over half the capacity are in none: each begins a sequence."""
    out, top = [], capacity // 2
    while top:
        out.append((top // CLASS, top))
        top //= CLASS
    return out


def place(length: np.ndarray, gap: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The rounds in one task: for each piece the number of its gap, and its offset. Gaps beyond those given are whole sequences."""
    where, offset = np.full(len(length), -1), np.zeros(len(length), np.int64)
    gap = gap.astype(np.int64)
    for low, top in classes(capacity):
        mine = np.flatnonzero((length > low) & (length <= top))
        while len(mine):
            use = np.flatnonzero(gap >= length[mine].min())
            if not len(use):
                gap = np.concatenate([gap, np.full(-(-length[mine].sum() // capacity), capacity)])
                continue
            of, size = slots_of(gap[use], top, 1 + len(mine) // len(use))
            slot = np.arange(len(of) + len(mine)) < len(of)
            order = np.lexsort((~slot, -np.concatenate([size, length[mine]])))
            slots, docs = (order[x] for x in matched(slot[order]))
            to, piece = use[of[slots]], mine[docs - len(of)]
            by = np.lexsort((piece, to))
            to, piece = to[by], piece[by]
            before = np.cumsum(length[piece]) - length[piece]
            first = np.concatenate([[True], to[1:] != to[:-1]])
            where[piece], offset[piece] = to, capacity - gap[to] + before - before[first][np.cumsum(first) - 1]
            np.subtract.at(gap, to, length[piece])
            mine = mine[where[mine] < 0]
    return where, offset


def finish(docs: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """item, sequence_id, offset of a bounded number of pieces and gaps, in one task."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.stack([np.asarray(b.column(c), np.int64) for c in ("kind", "id", "size")]) for b in given if b.num_rows]
        if not rows:
            return
        kind, id, size = np.concatenate(rows, 1)
        order = np.lexsort((id, -size))
        kind, id, size = kind[order], id[order], size[order]
        doc = kind == DOC
        where, offset = place(size[doc], size[~doc], capacity)
        # a new sequence has the number of one of its pieces
        item, old = id[doc], id[~doc]
        fresh = np.full(int(where.max(initial=-1)) + 1, -1)
        fresh[where] = item
        fresh[: len(old)] = old[: len(fresh)]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(fresh[where]), pa.array(offset)], ["item", "sequence_id", "offset"])

    rows = docs.select(F.lit(DOC).alias("kind"), F.col("item").alias("id"), F.col("length").alias("size")).unionByName(gaps.select(F.lit(SLOT).alias("kind"), F.col("sequence_id").alias("id"), F.col("gap").alias("size")))
    return rows.repartition(1).mapInArrow(run, "item long, sequence_id long, offset long")


def sweep(docs: DataFrame, gaps: DataFrame, top: int, each: int) -> DataFrame:
    """One round's matches, written: kind PAIR with sequence_id, gap, item, length; and the pieces that found no slot: kind DOC with item and length.

    Slots and pieces are sorted by ranges of size and swept in each range. What is left there, free slots and pieces without
    one, only matches over ranges: again like brackets, of which a range has so many closing and then so many opening
    ones. These numbers, two a range, say which rank of one range's pieces meets which rank of another's slots.
    """
    each_slot = F.least(F.greatest(F.floor(F.col("gap") / top), F.lit(1)), F.lit(each)).cast("int")
    slots = gaps.select("sequence_id", "gap", F.posexplode(F.array_repeat(F.lit(top), each_slot)).alias("n", "size"), each_slot.alias("m"))
    size = F.when(F.col("n") == F.col("m") - 1, F.col("gap") - F.col("n") * top).otherwise(F.col("size")).cast("long")
    rows = slots.select(size.alias("size"), F.lit(SLOT).alias("kind"), F.col("sequence_id").alias("id"), "gap").unionByName(docs.select(F.col("length").alias("size"), F.lit(DOC).alias("kind"), F.col("item").alias("id"), F.lit(0).cast("long").alias("gap")))
    by = [F.col("size").desc(), F.col("kind"), F.xxhash64("id"), F.col("id")]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [np.stack([np.asarray(b.column(c), np.int64) for c in ("size", "kind", "id", "gap")]) for b in given if b.num_rows]
        if not held:
            return
        size, kind, id, gap = np.concatenate(held, 1)
        slot = kind == SLOT
        a, b = matched(slot)
        free = np.ones(len(kind), bool)
        free[a] = free[b] = False
        docs, slots = np.flatnonzero(free & ~slot), np.flatnonzero(free & slot)[::-1]  # the slot that came last first
        columns = {"kind": [np.full(len(a), PAIR), kind[docs], kind[slots]], "sequence_id": [id[a], 0 * docs, id[slots]], "gap": [gap[a], 0 * docs, gap[slots]], "item": [id[b], id[docs], 0 * slots], "length": [size[b], size[docs], 0 * slots]}
        columns |= {"rank": [0 * a, np.arange(len(docs)), np.arange(len(slots))]}
        whole = {k: np.concatenate(v) for k, v in columns.items()}
        whole["part"] = np.full(len(whole["kind"]), part)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole.values()], list(whole))

    found = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "kind long, sequence_id long, gap long, item long, length long, rank long, part long"), "swept")
    counts = {(r["part"], r["kind"]): r["count"] for r in found.where(F.col("kind") != PAIR).groupBy("part", "kind").count().collect()}  # two a range
    open_slots: list[list[int]] = []
    runs = []  # (kind, part, first rank, number of ranks, number of the first pair)
    pairs = 0
    for part in sorted({p for p, _ in counts}):
        rank, left = 0, counts.get((part, DOC), 0)
        while left and open_slots:
            other, first, free = open_slots[-1]
            n = min(left, free)
            runs += [(DOC, part, rank, n, pairs), (SLOT, other, first, n, pairs)]
            rank, left, pairs = rank + n, left - n, pairs + n
            open_slots[-1][1:] = [first + n, free - n]
            if n == free:
                open_slots.pop()
        if n := counts.get((part, SLOT), 0):
            open_slots.append([part, 0, n])
    if not runs:
        return found.where(F.col("kind") != SLOT).select("kind", "sequence_id", "gap", "item", "length")
    spans = found.sparkSession.createDataFrame(runs, "kind long, part long, first long, n long, pair long")
    over = found.where(F.col("kind") != PAIR).join(F.broadcast(spans), ["kind", "part"], "left").where(F.col("n").isNull() | F.col("rank").between(F.col("first"), F.col("first") + F.col("n") - 1))
    over = over.withColumn("pair", F.col("pair") + F.col("rank") - F.col("first"))
    met = over.where((F.col("kind") == DOC) & F.col("pair").isNotNull()).select("pair", "item", "length").join(over.where((F.col("kind") == SLOT) & F.col("pair").isNotNull()).select("pair", "sequence_id", "gap"), "pair")
    # a range's pieces meet slots from the first rank on, so what is beyond its ranks that meet one found none
    ends = F.broadcast(spans.where(F.col("kind") == DOC).groupBy("part").agg(F.sum("n").alias("met")))
    alone = found.where(F.col("kind") == DOC).join(ends, "part", "left").where(F.col("rank") >= F.coalesce("met", F.lit(0)))
    names = ["kind", "sequence_id", "gap", "item", "length"]
    return found.where(F.col("kind") == PAIR).select(*names).unionByName(met.select(F.lit(PAIR).cast("long").alias("kind"), *names[1:])).unionByName(alone.select(*names))


def places(docs: DataFrame, gaps: DataFrame, capacity: int, few: int) -> list[DataFrame]:
    """item, sequence_id, offset of all pieces of docs (item, length; at most half the capacity), round by round. gaps: sequence_id, gap.

    A class of lengths at a time, the longest first. A round offers the gaps as slots to the class's pieces, best fit by
    best fit (sweep()), then takes what was placed from the gaps; with the next round they are sorted anew. When no gap is
    left that holds any of the pieces, as many sequences begin as these fill at least.
    """
    out: list[DataFrame] = []
    begun = 0
    for low, top in classes(capacity):
        mine = docs.where((F.col("length") > low) & (F.col("length") <= top))
        while True:
            of_class = mine.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("sum"), F.min("length").alias("least")).first()
            shorter = docs.where(F.col("length") <= low)
            rest = shorter.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least")).first()
            if not of_class["n"]:
                break
            gaps = gaps.where(F.col("gap") >= min(x for x in (of_class["least"], rest["least"]) if x))
            fitting = gaps.where(F.col("gap") >= of_class["least"])
            n, held = fitting.count(), gaps.count()
            if of_class["n"] + rest["n"] + held <= few:
                return [*out, finish(mine.select("item", "length").unionByName(shorter.select("item", "length")), gaps, capacity)]
            if not n:
                more = -(-of_class["sum"] // capacity)
                gaps = gaps.unionByName(docs.sparkSession.range(begun + 1, begun + more + 1).select((-F.col("id")).alias("sequence_id"), F.lit(capacity).cast("long").alias("gap")))
                begun += more
                continue
            found = written(sweep(mine, fitting, top, 1 + of_class["n"] // n), "round")
            pairs = found.where(F.col("kind") == PAIR)
            # a sequence gets so many pieces a round as it has tokens at most
            kept = pairs.groupBy("sequence_id", "gap").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("p"))
            taken = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
            offsets = F.transform("p", lambda x, i: F.struct(x["item"].alias("item"), (F.lit(capacity) - F.col("gap") + F.aggregate(F.slice("p", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["length"])).alias("offset")))
            kept = written(kept.select("sequence_id", taken.alias("taken"), offsets.alias("p")), "placed")
            out.append(kept.select("sequence_id", F.explode("p").alias("x")).select("x.item", "sequence_id", "x.offset"))
            gaps = written(gaps.join(kept.select("sequence_id", "taken"), "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
            mine = found.where(F.col("kind") == DOC).select("item", "length")
    return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, few: int = FEW) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces over half the capacity begin a sequence each; the others are placed in rounds over the cluster (see places()),
    of which a few score are enough whatever the number of documents. No task holds more than a range of sizes, or `few`
    pieces and gaps. A null text is empty and makes a piece of the end's id alone. Repeated rows are packed each. An empty
    table gives no pieces. Other columns don't matter.
    """
    cut = written(pieces(docs, key, text, path, capacity, end), "pieces")
    half = capacity // 2
    long = cut.where(F.col("length") > half)
    found = places(cut.where(F.col("length") <= half).select("item", "length"), long.select(F.col("item").alias("sequence_id"), (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0"), capacity, few)
    out = long.withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    if found:
        placed = functools.reduce(DataFrame.unionByName, found)
        out = out.unionByName(cut.where(F.col("length") <= half).join(placed, "item").select(*cut.columns, "sequence_id", "offset"))
    return out.drop("item")
