"""Language-model scoring by context-tree weighting over bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import arrow_type, block_docs, block_table, bucket_count, dealt, mixed, packed, per_block, per_block_with, rows_of, sorted_packed, sorted_unpacked, text_bytes, unpacked
from quarry.llm.common import written

#: Bytes of context; the tree's leaves are at this depth. Contexts and nodes are numbers of 64 bits, which is enough for MOST_DEPTH.
DEPTH, MOST_DEPTH = 5, 6
#: A bucket's arrays of so many blocks are put together at once, and then the sums of so many.
TOGETHER = 256
#: Of crc32(doc_id as text) modulo 7, the remainder that isn't learnt from.
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 4 << 20
WORDS, GRAMS = 0, 1
SENT = "block long, bucket int, kind int, keys binary, counts binary"
RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x > 0: Stirling's series, after moving x up to 8 at least."""
    shift, low = np.zeros_like(x), x.copy()
    while (small := low < 8).any():
        shift[small] += np.log(low[small])
        low[small] += 1
    r = 1 / (low * low)
    return (low - 0.5) * np.log(low) - low + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / low - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Tree:
    """The context tree's nodes for some byte strings (context and the byte after it), from one depth to another.

    grams: strings as numbers, the byte just before in the highest of depth + 1 bytes, the byte itself in the lowest.
    Each byte is 8 binary decisions; at each, a context has a node of its own: its number is the context and the bits so
    far. A node weighs its own KT estimate against its children's (the contexts one byte longer) evenly, a priori.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int, depth: int) -> None:
        byte = (grams & np.uint64(255)).astype(np.int64)
        steps = np.arange(8)
        node = (1 << steps) | (byte[:, None] >> (8 - steps))
        self.bit = ((byte[:, None] >> (7 - steps)) & 1).astype(bool)
        self.top, self.depth = top, depth
        self.back, self.zeros, self.ones, self.own, self.all, self.keys = {}, {}, {}, {}, {}, {}
        weight = np.repeat(counts.astype(np.float64), 8)
        for d in range(depth, top - 1, -1):
            context = (grams >> np.uint64(8 * (depth + 1 - d))).astype(np.int64)
            self.keys[d], back = np.unique(context[:, None] * 256 + node, return_inverse=True)
            self.back[d] = back = back.reshape(-1, 8)
            n = len(self.keys[d])
            self.ones[d] = np.bincount(back.ravel(), weight * self.bit.ravel(), n)
            self.zeros[d] = np.bincount(back.ravel(), weight * ~self.bit.ravel(), n)
            self.own[d] = self.all[d] = log_kt(self.zeros[d], self.ones[d])
            if d < depth:
                parent = np.zeros(len(self.keys[d + 1]), np.int64)
                parent[self.back[d + 1].ravel()] = back.ravel()
                self.all[d] = weighed(self.own[d], np.bincount(parent, self.all[d + 1], n))

    def log10(self, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each gram, the logarithm of its last byte's probability. above: for the depths from 0 up to the top, of each node (context * 256 + bits) its weight and its estimate of a one."""
        chance = None
        for d in range(self.depth, -1, -1):
            if d >= self.top:
                at = self.back[d]
                one = (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)
                weight = np.exp(self.own[d] - np.log(2) - self.all[d])
            else:
                at = (self.keys[self.top][self.back[self.top]] >> 8 >> (8 * (self.top - d))) * 256 + (self.keys[self.top][self.back[self.top]] & 255)
                weight, one = above[d]
            own = np.where(self.bit, one[at], 1 - one[at])
            chance = own if chance is None else weight[at] * own + (1 - weight[at]) * chance
        return np.log10(chance).sum(1)


def weighed(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2)


def dealt_grams(grams: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted grams' order by bucket, then by themselves, and where each bucket's end. The context's last two bytes decide the bucket."""
    bucket = mixed(grams >> np.uint64(8 * (depth - 1)), 5) >> np.uint64(64 - buckets.bit_length() + 1)
    return np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable"), np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))


def grams_of(flat: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """At each byte, it and the `depth` before it in its document; 0 before the document."""
    at = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
    out = flat.astype(np.uint64)
    for back in range(1, depth + 1):
        out[back:] |= np.where(at[back:] >= back, flat[:-back], 0).astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    return out


def is_held_out(keys: pa.Array) -> np.ndarray:
    """Null counts as an empty text."""
    return np.array([zlib.crc32(("" if x is None else str(x)).encode()) % FOLDS == HELD_OUT for x in keys.to_pylist()], bool)


class Words:
    """A block's distinct words, with A-Z lowered, in the order of their hashes."""

    def __init__(self, text: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
        words, counts = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
        there = np.asarray(pc.binary_length(words), np.int64) > 0
        self.doc = np.repeat(np.arange(len(counts)), counts)[there]
        self.counts = np.bincount(self.doc, minlength=len(counts))
        coded = words.filter(pa.array(there)).dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
        self.hashes, back = np.unique(hashes, return_inverse=True)
        self.at = back[np.asarray(coded.indices, np.int64)] if len(hashes) else np.zeros(0, np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    block, bucket, kind, keys, counts = zip(*rows) if rows else ((),) * 5
    return rows_of({"block": (block, pa.int64()), "bucket": (bucket, pa.int32()), "kind": (kind, pa.int32()), "keys": (keys, pa.binary()), "counts": (counts, pa.binary())})


def _send(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    return [(block, bucket, kind, sorted_packed(keys[part]), packed(counts[part])) for bucket, part in dealt(keys, buckets)]


def _send_grams(block: int, grams: np.ndarray, counts: np.ndarray, depth: int, buckets: int) -> list[tuple]:
    order, ends = dealt_grams(grams, depth, buckets)
    parts = zip(np.split(order, ends[:-1]), range(buckets))
    return [(block, bucket, GRAMS, sorted_packed(grams[part]), packed(counts[part] if len(counts) else counts)) for part, bucket in parts if len(part)]


def _parts(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows by block; their keys and counts after one another, and where each row's end."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys, counts = [sorted_unpacked(r["keys"]) for r in rows], [unpacked(r["counts"], "<i8") for r in rows]
    return rows, np.concatenate(keys), np.concatenate(counts), np.cumsum([len(x) for x in keys])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, depth: int = DEPTH, together: int = TOGETHER) -> DataFrame:
    """One row per document: doc_id and RESULT.

    score is the log10 probability of the text's bytes under a binary context tree of this depth learnt from the
    documents that aren't held out: Krichevsky-Trofimov estimates of all depths, mixed by their posterior weights. Before
    a document's first byte stand zeros. base_score sums log10((c + 1) / (N + V + 1)) over its words and one end.
    A null text is empty (score 0, one token); a null id is learnt from. Equal texts get equal scores; whole texts are
    read, in blocks; an empty table gives no rows; other columns don't matter. Words go by 64-bit hashes.

    The tree is never in one place: what has the same last two bytes of context shares a bucket, which holds the subtrees
    from depth 2 on; depths 0 and 1, 65,792 nodes at most, are put together on the driver and sent to all. A bucket's grams
    come from all blocks: they are summed for `together` blocks at a time, then again their sums, and so on; and they are
    answered for so many blocks at a time. So a task holds what a subtree has of different grams, however large the corpus
    and however frequent its two bytes.
    """
    if not 2 <= depth <= MOST_DEPTH:
        raise ValueError(f"the depth must be from 2 to {MOST_DEPTH}")
    blocks = block_table(docs, key, text, block_bytes)
    buckets = bucket_count(blocks)
    n_blocks = blocks.count()
    kind = docs.schema[key].dataType.simpleString()

    def send_words(block: int, held: bytes) -> pa.RecordBatch:
        keys, texts = block_docs(held)
        words, learnt = Words(texts), ~is_held_out(keys)
        counts = np.bincount(words.at, learnt[words.doc], len(words.hashes)).astype(np.int64)
        # the ends' count goes to every bucket's row of its own
        return _batch(_send(block, WORDS, words.hashes, counts, buckets) + [(block, -1, WORDS, sorted_packed(np.zeros(1, np.uint64)), packed(np.array([learnt.sum()], np.int64)))])

    def count_words(table: pa.Table) -> pa.Table:
        rows, keys, counts, ends = _parts(table)
        found, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, counts, len(found)).astype(np.int64)
        each = total[back]
        bucket = rows[0]["bucket"]
        # for the sums: how many words and different ones were learnt
        sums = np.array([total.sum(), (total > 0).sum()], np.int64)
        out = [(r["block"], bucket, WORDS, b"", packed(x)) for r, x in zip(rows, np.split(each, ends[:-1]))] if bucket >= 0 else []
        return pa.Table.from_batches([_batch([*out, (-1, bucket, WORDS, b"", packed(sums))])])

    def send_grams(counted: bool):
        def run(block: int, held: bytes) -> pa.RecordBatch:
            keys, texts = block_docs(held)
            flat, starts = text_bytes(texts)
            grams = grams_of(flat, starts, depth)
            if not counted:
                return _batch(_send_grams(block, np.unique(grams), np.zeros(0, np.int64), depth, buckets))
            found, counts = np.unique(grams[np.repeat(~is_held_out(keys), np.diff(starts))], return_counts=True)
            return _batch(_send_grams(block, found, counts.astype(np.int64), depth, buckets))

        return run

    def sum_grams(table: pa.Table) -> pa.Table:
        rows, keys, counts, _ = _parts(table)
        found, back = np.unique(keys, return_inverse=True)
        return pa.Table.from_batches([_batch([(rows[0]["block"], rows[0]["bucket"], GRAMS, sorted_packed(found), packed(np.bincount(back, counts, len(found)).astype(np.int64)))])])

    def summed(sent: DataFrame) -> DataFrame:
        several = n_blocks
        while several > 1:
            several = -(-several // together)
            sent = sent.groupBy("bucket", F.pmod(F.hash("block", F.lit(several)), F.lit(several))).applyInArrow(sum_grams, SENT)
            sent = written(sent, "grams")
        return sent if n_blocks > 1 else written(sent, "grams")

    def upper_nodes(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each node of depth 1, what this bucket has below it."""
        for batch in given:
            for r in batch.to_pylist():
                tree = Tree(sorted_unpacked(r["keys"]), unpacked(r["counts"], "<i8"), 2, depth)
                node = (tree.keys[2] >> 16) * 256 + (tree.keys[2] & 255)
                found, back = np.unique(node, return_inverse=True)
                sums = [np.bincount(back, x, len(found)) for x in (tree.zeros[2], tree.ones[2], tree.all[2])]
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], ["node", "zeros", "ones", "below"])

    def answer_grams(sent: pa.Table, model: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        keys = [sorted_unpacked(r["keys"]) for r in rows]
        found = np.unique(np.concatenate(keys)) if rows else np.zeros(0, np.uint64)
        out = []
        if len(found):
            # the nodes need all that was learnt, whether these blocks ask for it or not
            learnt, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for r in model.to_pylist():
                learnt, n = sorted_unpacked(r["keys"]), unpacked(r["counts"], "<i8")
            every = np.union1d(found, learnt)
            counts = np.zeros(len(every), np.int64)
            counts[np.searchsorted(every, learnt)] = n
            logs = Tree(every, counts, 2, depth).log10(above)
            out = [(r["block"], r["bucket"], GRAMS, b"", packed(logs[np.searchsorted(every, x)])) for r, x in zip(rows, keys)]
        return pa.Table.from_batches([_batch(out)])

    def last(block: int, held: bytes, answers: list[dict]) -> pa.RecordBatch:
        keys, texts = block_docs(held)
        held_out, n = is_held_out(keys), len(keys)
        words = Words(texts)
        get = lambda k, t: np.concatenate([np.zeros(0, t), *(unpacked(r["counts"], t) for r in answers if r["kind"] == k)])
        count = get(WORDS, "<i8")[words.at]
        log = lambda c: np.log10((c + 1) / (total + different + 1))
        base = np.bincount(words.doc, log(count), n) + log(ends)
        known = np.bincount(words.doc, count > 0, n) + (ends > 0)
        flat, starts = text_bytes(texts)
        size = np.diff(starts)
        found, back = np.unique(grams_of(flat, starts, depth), return_inverse=True)
        logs = np.empty(len(found))
        logs[dealt_grams(found, depth, buckets)[0]] = get(GRAMS, "<f8")
        sums = np.bincount(np.repeat(np.arange(n), size), logs[back], n)  # in the order of the bytes, so equal texts have equal sums
        columns = [keys, held_out, words.counts + 1, known.astype(np.int64), np.full(n, total), base, sums, np.where(size > 0, -sums / np.log10(2) / np.maximum(size, 1), 0.0)]
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    words = written(per_block(blocks, send_words, SENT).groupBy("bucket").applyInArrow(count_words, SENT), "words")
    total = different = ends = 0
    for row in words.where("block = -1").select("bucket", "counts").toLocalIterator():  # two numbers a bucket
        n, v = unpacked(bytes(row["counts"]), "<i8").tolist()
        total, different = total + n, different + v
        ends += n if row["bucket"] == -1 else 0
    model = summed(per_block(blocks, send_grams(True), SENT))
    sums = model.select("keys", "counts").mapInArrow(upper_nodes, "node long, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    node, zeros, ones, below = (np.array(x) for x in zip(*sums.orderBy("node").collect())) if model.count() else (np.zeros(0, np.int64), *(np.zeros(0),) * 3)
    full = [np.bincount(node.astype(np.int64), x, 65536) for x in (zeros, ones, below)]
    own = log_kt(full[0], full[1])
    first = (np.exp(own - np.log(2) - weighed(own, full[2])), (full[1] + 0.5) / (full[0] + full[1] + 1))
    root = [x.reshape(256, 256).sum(0) for x in (full[0], full[1], weighed(own, full[2]))]
    own = log_kt(root[0], root[1])
    above = [(np.exp(own - np.log(2) - weighed(own, root[2])), (root[1] + 0.5) / (root[0] + root[1] + 1)), first]
    slices = max(1, -(-n_blocks // together))
    asked = per_block(blocks, send_grams(False), SENT).withColumn("slice", F.pmod(F.hash("block"), F.lit(slices)))
    model = model.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    grams = asked.groupBy("bucket", "slice").cogroup(model.groupBy("bucket", "slice")).applyInArrow(answer_grams, SENT)
    answers = words.where("block >= 0").unionByName(grams)
    shape = pa.schema(list(zip(names, [arrow_type(docs, key), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()])))
    return per_block_with(blocks, answers, last, f"doc_id {kind}, {RESULT}", shape)
