"""Exact top-k search by MaxScore over the components of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

K, EVERY = 5, 50
#: Rows of a shard and of a block of queries; two of them meet in a task.
SHARD, BLOCK = 16384, 4096
#: Sums below this are exact as doubles.
EXACT = 2**53
#: Rows whose whole score seeds the threshold of a query, besides k + 1.
SEEDS = 64
FOUND = "query_id long, q long, vec_id long, score long, over int, wide string, own boolean"


class Postings(NamedTuple):
    """A term's list: what its rows have beyond the least that any row of the shard has; rows: None if all stand in it."""

    rows: np.ndarray | None
    gains: np.ndarray


def _list(gains: np.ndarray) -> Postings:
    rows = np.flatnonzero(gains)
    return Postings(rows, gains[rows]) if 2 * len(rows) <= len(gains) else Postings(None, gains)


class Shard:
    """Rows and their postings. The numbers are whole ones, as doubles or as Python's, and so are all sums.

    A term is a component. A query with a positive weight gains by values over the shard's least one, a query with a
    negative weight by values under the greatest; the rows at that end aren't in the term's list.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.low, self.high = values.min(0), values.max(0)
        self.up = [_list(v - low) for v, low in zip(values.T, self.low)]
        self.down = [_list(high - v) for v, high in zip(values.T, self.high)]

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows (index, score), by score, then id.

        Terms go by what they can add at most. The whole scores of some rows set a threshold; the weakest terms, which
        together can't lift a row to it, aren't essential: rows that stand in none of the other lists are never looked
        at. Essential lists are gone through; the other terms are probed for the rows that can still get to the threshold,
        which rises with them.
        """
        n = len(self.ids)
        ends = query * self.low, query * self.high
        base = np.minimum(*ends).sum()
        bound = np.maximum(*ends) - np.minimum(*ends)
        terms = sorted(np.flatnonzero(bound).tolist(), key=lambda t: (-bound[t], t))
        lists = {t: self.up[t] if query[t] > 0 else self.down[t] for t in terms}
        rest = np.zeros(len(terms) + 1, bound.dtype)  # what the terms from each on add at most
        rest[:-1] = np.cumsum(bound[terms][::-1])[::-1]
        least = None
        essential = len(terms)
        if n > k + SEEDS and terms:
            first = lists[terms[0]]
            best = np.argpartition(-first.gains.astype(np.float64), min(k + SEEDS, len(first.gains)) - 1)[: k + SEEDS]
            seeds = best if first.rows is None else first.rows[best]
            sums = np.sort(self.values[seeds] @ query - base)
            least = sums[-k] if len(sums) >= k else None
        if least is not None:
            essential = next((i for i in range(len(terms) + 1) if rest[i] < least), len(terms))
        total = np.zeros(n, bound.dtype)
        seen = np.zeros(n, bool)
        for t in terms[:essential]:
            rows, gains = lists[t]
            if rows is None:
                total += abs(query[t]) * gains
                seen |= gains > 0
            else:
                total[rows] += abs(query[t]) * gains
                seen[rows] = True
        rows = np.flatnonzero(seen) if least is not None else np.arange(n)
        total = total[rows]
        for i in range(essential, len(terms) + 1):
            if len(rows) > k:
                now = np.partition(total, len(rows) - k)[len(rows) - k]
                least = now if least is None or now > least else least
                hope = total + rest[i] >= least
                rows, total = rows[hope], total[hope]
            if i < len(terms):
                t = terms[i]
                value = self.values[rows, t]
                total = total + abs(query[t]) * (value - self.low[t] if query[t] > 0 else self.high[t] - value)
        best = np.lexsort((self.ids[rows], -total))[:k]
        return rows[best], total[best] + base


def whole(vectors: np.ndarray) -> np.ndarray:
    """256 times the components, which are whole numbers then, as Python's."""
    return np.array([[int(x) * 256 if abs(x) >= 2.0**52 else int(x * 256) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape)


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int, bool]]:
    """(query's index, row's id, score, whether the row may be the query itself): the k best rows for each query, and one more.

    rows and queries: components as multiples of 1/256. Those with large components are searched with Python's numbers,
    in lists of their own; all others as doubles, in which their sums are exact.
    """
    dims = max(rows.shape[1], queries.shape[1], 1)
    rows, queries = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (rows, queries))
    narrow = lambda x: np.abs(x).max(1, initial=0) <= (EXACT / 8 / dims) ** 0.5 / 256
    row_narrow, query_narrow = narrow(rows), narrow(queries)
    found: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(queries))]
    for which, asked, exact in ((row_narrow, query_narrow, False), (row_narrow, ~query_narrow, True), (~row_narrow, np.ones(len(queries), bool), True)):
        if not which.any() or not asked.any():
            continue
        plain = whole if exact else (lambda x: x * 256.0)
        shard = Shard(ids[which], plain(rows[which]))
        at = np.flatnonzero(which)
        for i, q in zip(np.flatnonzero(asked).tolist(), plain(queries[asked])):
            best, scores = shard.top(q, k + 1)
            own = (ids[at[best]] == query_ids[i]) & (rows[at[best]] == queries[i]).all(1)
            found[i] += [(i, r, int(s), o) for r, s, o in zip(ids[at[best]].tolist(), scores.tolist(), own.tolist())]
    for x in found:
        yield from sorted(x, key=lambda f: (-f[2], f[1], not f[3]))[: k + 1]


def _matrix(rows: pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with 0."""
    sizes = np.diff(np.asarray(rows.offsets, np.int64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(rows.flatten(), np.float64)
    return out


def spoken(score: int) -> tuple[int | None, int, str]:
    """A score as (long, over, wide): beyond a long's range, over is 1 or -1, and wide has the order of such scores."""
    if -(2**63) <= score < 2**63:
        return score, 0, ""
    digits = f"{abs(score):d}"
    wide = f"{len(digits):06d}{digits}"
    return (None, 1, wide) if score > 0 else (None, -1, "".join(str(9 - int(c)) for c in wide))


def top(vectors: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    A component x counts as floor(256 * x); the score is the inner product, exact whatever the components. All rows but
    the query's own are candidates; of rows that repeat the query's id and vector, one is its own. Repeated query rows are
    one query. Ties go to the smaller id. A score beyond a long's range is null and ranks by its value. Vectors that are
    null, or hold null or non-finite components, and null ids take no part; a shorter vector counts as filled up with 0.
    Shards of rows meet blocks of queries in a grid, each with a bounded number of rows; a shard gives k + 1 rows a query,
    and these are merged.
    """
    # floor gives a long; from 2**52 on, a double is whole anyway
    cut = lambda y: F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double") / F.lit(256.0)).otherwise(y / F.lit(256.0))
    parts = F.transform(F.col(vector), lambda x: F.when(F.abs(x.cast("double")) < F.lit(2.0**52), cut(F.lit(256.0) * x.cast("double"))).otherwise(x.cast("double")))
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = written(vectors.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), parts.alias("v")), "vectors")
    asked = rows.where(F.col("id") % every == 0).distinct()
    n, m = rows.count(), asked.count()
    shards, blocks = max(8, -(-n // SHARD)), max(1, -(-m // BLOCK))
    deal = lambda c, into: F.pmod(F.xxhash64(*c), F.lit(into)).cast("int")
    left = rows.withColumn("s", deal(("id", F.lit(1), F.monotonically_increasing_id()), shards)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("q", F.xxhash64("id", "v")).withColumn("b", deal(("id", "v"), blocks)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shape = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.int32()), ("wide", pa.string()), ("own", pa.bool_())])

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return shape.empty_table()
        get = lambda t, c: t.column(c).combine_chunks()
        ids, asked_ids, which = (np.asarray(get(*x), np.int64) for x in ((shard, "id"), (block, "id"), (block, "q")))
        found = [(int(asked_ids[i]), int(which[i]), r, *spoken(s), own) for i, r, s, own in search_shard(ids, _matrix(get(shard, "v")), asked_ids, _matrix(get(block, "v")), k)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), shape.types)], schema=shape)

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(run, FOUND)
    # rows that may be the query itself are equal in score and id, so they stand together
    order = [F.col("over").desc(), F.col("score").desc(), F.col("wide").desc(), F.col("vec_id"), F.col("own").desc()]
    per = Window.partitionBy("query_id", "q").orderBy(*order)
    first = found.withColumn("_n", F.row_number().over(per)).where(F.col("_n") <= k + 1)
    first = first.withColumn("_own", F.sum(F.col("own").cast("int")).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    others = first.where(~(F.col("own") & (F.col("_own") == 1)))
    return others.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
