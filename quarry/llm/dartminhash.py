"""MinHash near-dedup over weighted word shingles, by DartMinHash signatures, banded joins and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import mixed
from quarry.llm.common import batches, word_count, word_lists, written

WORDS, LEAST = 5, 0.8
#: Bands of rows. Two texts of similarity 0.8 meet in one with a chance of 1 - (1 - 0.8**5)**24 = 0.99993.
BANDS, ROWS = 24, 5
#: Buckets of so many texts are finished in one task after the first round; a task has about so many rows.
SMALL, TASK_ROWS = 2048, 8192
#: Cells of the bound on shared shingles (a power of 2), and the greatest count that one holds.
CELLS, FULL = 256, 65535
#: Texts sketched at once: each throws about as many darts, however short it is.
SKETCH_ROWS = 512
#: Darts a coordinate besides the logarithm of their number, as the first throw.
SPARE = 2.0
#: Bits of the sift for each row of the buckets, and at most (2 MB in all).
SIFT_BITS, SIFT_MOST = 8, 1 << 24


def shingles(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each five words in sequence, words with A-Z lowered; a text of one to four words is one shingle."""
    words, counts = word_lists(pa.RecordBatch.from_arrays([pc.ascii_lower(batch.column(text))], ["text"]))
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = hashes[np.asarray(coded.indices, np.int64)] if len(hashes) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    start = np.flatnonzero((np.arange(len(word)) + WORDS <= ends[row]) | (np.arange(len(word)) == ends[row] - counts[row]))
    out = np.full(len(start), WORDS, np.uint64)
    for k in range(WORDS):
        at = start + k
        inside = at < ends[row[start]]
        out = np.where(inside, mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ word[np.minimum(at, len(word) - 1)]), out) if len(start) else out
    return row[start], out


def elements(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, element) in order, with their weights: how often each comes."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row))).astype(np.float64)


def uniform(x: np.ndarray) -> np.ndarray:
    """A number over 0, up to 1, from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740992.0


def sketch(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, coordinates: int) -> np.ndarray:
    """DartMinHash: a signature (rows x coordinates) for each row's weighted set; equal in a coordinate with the chance of the sets' weighted Jaccard similarity.

    Over each element lies the plane of weight and rank, and hashed darts fall on it: a Poisson process of rate 1, the
    same in whatever set the element is. An element's region is what lies under its weight, cut into cells of width 1
    (the last one partly). In a cell, darts come in order of rank, each a step further by an exponential variable from
    the hash; a dart also has a place in the cell's width, and counts if that lies under the weight, and a coordinate.
    Each coordinate keeps its earliest dart. A set of total weight w throws up to rank (log k + SPARE) * k / w, about
    k * log k darts in all however large it is; a row with a coordinate without a dart is thrown again, twice as far.
    """
    best = np.full((rows, coordinates), np.inf)
    name = np.zeros((rows, coordinates), np.uint64)
    total = np.bincount(row, weight, rows)
    reach = coordinates * (np.log(coordinates) + SPARE) / np.maximum(total, 1e-9)
    cells = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(row)), cells)
    index = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.minimum(1.0, weight[of] - index)
    seed = mixed(element[of] + index.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 11)
    owner = row[of]
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(rows, bool)
        wanted[todo] = True
        live = wanted[owner]
        s, w, o = seed[live], width[live], owner[live]
        rank, darts = np.zeros(len(s)), []
        state = s.copy()
        while len(s):
            state = mixed(state, 1)
            rank = rank - np.log(uniform(state))
            there = rank < reach[o]
            state, rank, w, o, s = state[there], rank[there], w[there], o[there], s[there]
            place = mixed(state, 2)
            hit = uniform(place) <= w
            darts.append((o[hit], rank[hit], mixed(state, 3)[hit]))
        at, ranks, names = (np.concatenate(x) for x in zip(*darts))
        # coordinate from the high bits of the product, the dart's name from all
        where = at * coordinates + ((names >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((ranks, where))
        first = order[np.concatenate([[True], where[order][1:] != where[order][:-1]])] if len(order) else order
        best.ravel()[where[first]] = ranks[first]
        name.ravel()[where[first]] = names[first]
        todo = todo[~np.isfinite(best[todo]).all(1)]
        reach[todo] *= 2
    return name


def text_hash(text: Column) -> Column:
    """128 bits; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, h (the text's 128-bit hash), weight, bands (null without words)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given, rows=SKETCH_ROWS):
            row, element, weight = elements(*shingles(batch, "text"))
            n = batch.num_rows
            signature = sketch(row, element, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
            band = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
            for k in range(ROWS):
                band = mixed(band * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, :, k])
            total = np.bincount(row, weight, n)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)), mask=pa.array(total == 0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(total.astype(np.int64)), bands], ["id", "h", "weight", "bands"])

    return docs.select(F.col(key).alias("id"), text_hash(F.col(text)).alias("h"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, h binary, weight long, bands array<long>")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two packed sets: sorted hashes, each as often as its weight says."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return 0.0
    number = lambda v: np.arange(len(v)) - np.searchsorted(v, v)  # noqa: E731  the n-th of its kind
    x, y = mixed(x + number(x).astype(np.uint64), 7), mixed(y + number(y).astype(np.uint64), 7)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sets_of(rows: DataFrame) -> DataFrame:
    """h, its text's shingles, packed, and how many fall in each cell. rows: h, text."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            row, hashes = shingles(batch, "text")
            order = np.lexsort((hashes, row))
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            sets = [hashes[order[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            cells = np.zeros((batch.num_rows, CELLS), np.int64)
            np.add.at(cells, (row, (hashes & np.uint64(CELLS - 1)).astype(np.int64)), 1)
            cells = [x.tobytes() for x in np.minimum(cells, FULL).astype("<u2")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(sets, pa.binary()), pa.array(cells, pa.binary())], ["h", "set", "cells"])

    return rows.select("h", "text").mapInArrow(run, "h binary, set binary, cells binary")


def checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is `least` or more."""
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("set_b")), "b")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            good = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (h, label) with each component of the links' graph over the labels set to its least label.

    Each round, a label takes the least label it is linked with, then the label of that one: chains halve. The rows are
    labels and links between different labels only; nothing is collected.
    """
    edges = links.join(labels.select(F.col("h").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("h").alias("b"), F.col("label").alias("y")), "b")
    edges = written(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    roots = written(edges.select(F.explode(F.array("x", "y")).alias("label")).distinct().withColumn("root", F.col("label")), "roots")
    while True:
        near = edges.join(roots.select(F.col("label").alias("x"), F.col("root").alias("rx")), "x").join(roots.select(F.col("label").alias("y"), F.col("root").alias("ry")), "y")
        near = near.where("rx <> ry").select(F.greatest("rx", "ry").alias("label"), F.least("rx", "ry").alias("to"))
        hooks = written(near.groupBy("label").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            break
        parent = roots.select(F.col("root").alias("label")).distinct().join(hooks, "label", "left").select(F.col("label").alias("root"), F.coalesce("to", "label").alias("up"))
        # every hook goes down to a lesser label, so following them ends; twice a round
        twice = written(parent, "parents")
        twice = twice.join(twice.select(F.col("root").alias("up"), F.col("up").alias("far")), "up").select("root", F.col("far").alias("up"))
        roots = written(roots.join(twice, "root").select("label", F.col("up").alias("root")), "roots")
    return labels.join(roots, "label", "left").select("h", F.coalesce("root", "label").alias("label"))


def bounded_pairs(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of different labels in a bucket that may be similar, for buckets of up to SMALL texts. rows: band, label, h, weight.

    A text's shingles are counted in CELLS cells by their hashes. Two texts share at most the sum of the cells' lesser
    counts, which bounds their similarity from above; most pairs that met by chance go out here, before they are rows.
    """
    many = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.join(sets.select("h", "cells"), "h").withColumn("task", F.pmod(F.xxhash64("band"), F.lit(many)))

    def run(table: pa.Table) -> pa.Table:
        band, label = (table.column(c).combine_chunks() for c in ("band", "label"))
        band = np.asarray(band, np.int64)
        names = np.asarray(label.dictionary_encode().indices, np.int64)
        weight = np.asarray(table.column("weight"), np.int64)
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), "<u2").reshape(-1, CELLS)
        order = np.argsort(band, kind="stable")
        found_a, found_b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            for i, x in enumerate(at[:-1].tolist()):
                y = at[i + 1 :]
                y = y[(names[y] != names[x]) & (np.minimum(weight[x], weight[y]) >= least * np.maximum(weight[x], weight[y]))]
                shared = np.minimum(cells[x], cells[y]).sum(1, dtype=np.int64)
                y = y[(shared >= least * (weight[x] + weight[y] - shared)) | (weight[x] >= FULL) | (weight[y] >= FULL)]
                found_a += [x] * len(y)
                found_b += y.tolist()
        h = table.column("h").to_pylist()
        pairs = {(min(h[x], h[y]), max(h[x], h[y])) for x, y in zip(found_a, found_b)}
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return dealt.select("task", "band", "label", "h", "weight", "cells").groupBy("task").applyInArrow(run, "a binary, b binary").distinct()


def linked(sets: DataFrame, bands: DataFrame, least: float) -> DataFrame:
    """labels (h, label): the texts that share a bucket with another, by component of links.

    A bucket is worked off in rounds. Some of its texts are hubs, those of labels with few texts there first; all texts of
    other labels are paired with the hubs, and then the hubs are done with. Among equals, the hub is the text that meets
    most others, which is mostly the same one in all bands, so pairs repeat and count once. Pairs whose sizes differ too
    much can't be similar; the others are checked on whole shingle sets. Linked labels are joined, and a bucket with one
    label is done. After the first round, buckets of up to SMALL texts are finished at once by bounded_pairs(), the
    others go on with four times as many hubs. So n texts that belong together cost n pairs, and no link between labels
    goes unseen.
    """
    state, hubs = bands, 1
    labels = written(bands.select("h", F.col("h").alias("label")).distinct(), "labels")
    tested = None
    while True:
        rows = state.join(labels, "h")
        counts = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        open_bands = counts.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all")).where("c > 1").select("band", "all")
        rows = written(rows.join(counts.join(open_bands, "band"), ["band", "label"]), "buckets")
        if rows.isEmpty():
            return labels
        small = F.lit(hubs > 1) & (F.col("all") <= SMALL)
        large = rows.where(~small)
        chosen = written(large.groupBy("band", F.pmod(F.xxhash64("h"), F.lit(hubs)).alias("sub")).agg(F.min(F.struct("n", -F.col("met"), "label", "h", "weight")).alias("hub")).select("band", "hub"), "hubs")
        near = F.least("weight", "hub.weight") >= F.lit(least) * F.greatest("weight", "hub.weight")
        pairs = large.join(chosen, "band").where((F.col("label") != F.col("hub.label")) & near).select(F.least("h", "hub.h").alias("a"), F.greatest("h", "hub.h").alias("b")).distinct()
        if hubs > 1:
            pairs = pairs.unionByName(bounded_pairs(rows.where(small).select("band", "label", "h", "weight"), sets, least)).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = written(checked(pairs, sets, least).repartition("a", "b"), "links")  # few rows, from as many tasks as the sets need
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not links.isEmpty():
            labels = written(components(links, labels), "labels")
        state = large.select("band", "h", "weight", "met").join(chosen.select("band", "hub.h"), ["band", "h"], "left_anti")
        hubs = min(4 * hubs, 1024)


def row_key(id: Column) -> Column:
    """Never null."""
    return F.coalesce(F.concat(F.lit("="), id.cast("string")), F.lit("-"))


def texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """h and d, a document's whole row, of the documents that have an id and a text's hash in wanted (id, h); each once: of rows that are equal in both, the least by its whole text. Rows are one column, so no names clash."""
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    rows = docs.select(whole.alias("d"), text_hash(F.col(text)).alias("h"), row_key(F.col(key)).alias("k"))
    rows = rows.join(wanted.select("h", row_key(F.col("id")).alias("k")), ["h", "k"])
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("h", "k").orderBy(F.col("d").cast("string")))).where("n = 1").select("h", "d")


def sifted(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """The rows (id, text) whose text may be in bands (h): all that are, and few others. It is told by broadcast bits, of which there are SIFT_MOST at most, so what is left out isn't shuffled."""
    bits = min(SIFT_MOST, 64 + SIFT_BITS * bands.count())
    place = lambda h: F.pmod(F.xxhash64(h), F.lit(bits))
    known = bands.select(place(F.col("h")).alias("place")).groupBy(F.expr("place div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
    rows = texts.withColumn("place", place(text_hash(F.col("text"))))
    rows = rows.join(F.broadcast(known), F.expr("place div 64") == F.col("at"))
    return rows.where(F.getbit("bits", F.expr("CAST(place % 64 AS INT)")) == 1).select("id", "text")


def grouped(docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """All rows (id, h, alone), and all texts with words (h, id, label): id is the least of the text's."""
    found = written(sketches(docs, key, text), "sketches")
    nodes = written(found.where("bands IS NOT NULL").groupBy("h").agg(F.min("id").alias("id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "nodes")
    bands = nodes.select("h", "weight", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a text that meets many others is the better hub: its copies then meet the same hub in all bands. It has BANDS rows at most
    met = F.sum("n").over(Window.partitionBy("h"))
    bands = written(bands.join(shared, "band").withColumn("met", met).drop("n"), "bands")
    wanted = nodes.join(bands.select("h").distinct(), "h").select("id", "h")
    texts = sifted(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), bands)
    found_texts = texts_of(texts, wanted, "id", "text").select("h", "d.text")
    sets = written(sets_of(found_texts), "sets")
    labels = linked(sets, bands, least)
    named = nodes.select("h", "id").join(labels, "h", "left").select("h", "id", F.coalesce("label", "h").alias("label"))
    return found.select("id", "h", F.col("bands").isNull().alias("alone")), named


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id (the least id in its class), class_size.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles (A-Z lowered; weights are counts)
    is `least` or more; a class is a component of links. Equal texts with words are one class and stand for each other
    throughout. Texts without words, null ones included, are alone, as is their row. Texts of one to four words are one
    shingle. Repeated rows fall into one class; of null ids, the least is null. Whole texts are read; an empty table
    gives no rows; other columns don't matter. Links are sought among texts that meet in one of BANDS buckets at least.
    """
    rows, named = grouped(docs, key, text, least)
    joined = rows.where("NOT alone").groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(named, "h")
    sizes = joined.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("id").alias("class_id"))
    by_text = joined.join(sizes, "label").select("h", "class_id", "class_size")
    out = rows.join(by_text.withColumn("alone", F.lit(False)), ["h", "alone"], "left")
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("alone"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Of each class of classes(), the document with the least id (null ids last); the columns of docs. Rows without words stay.

    Of rows with the same id and text, the least by all its columns stays, so reruns agree. A null text has no words; an
    empty table stays empty.
    """
    rows, named = grouped(docs, key, text, least)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("m")).select("m.id", "m.h")
    plain = docs.where(F.coalesce(word_count(F.col(text)), F.lit(0)) == 0)
    return texts_of(docs, first, key, text).select("d.*").unionByName(plain)
