"""Mixing sources to target weights by a curriculum whose weights change over the training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import spread_rank, word_count, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size, and so is what is taken of a document.
MOST_TIMES = 3
#: How a source's weight changes: its density at the training's start and end, in the order of WEIGHTS. The mean is 1, so the whole share stays the weight's.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
#: Sources are numbered in one task of a global sort up to so many; beyond it, by ranges.
FEW_SOURCES = 100_000


def numbered(sources: DataFrame) -> DataFrame:
    """Adds `at`, each source's place by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return sources.withColumn("at", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ranges = written(sources.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "sources")
    held = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    starts = held.withColumn("_n0", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_p").orderBy(*order)
    return ranges.join(starts, "_p").withColumn("at", F.col("_n0") + F.row_number().over(inside) - 1).drop("_p", "_n", "_n0")


def targets(sources: DataFrame, weights: Sequence[float], most_times: float) -> DataFrame:
    """Adds `weight` and `target`. sources: source, source_size.

    The sizes' sum is shared by weight. A source whose share would be above most_times its size is held there, and
    the excess is shared anew among the others, until none is above. Each round is one aggregation to one row.
    """
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = written(numbered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most_times))), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = F.col("most") <= level * F.col("weight")
        row = rows.agg(F.sum(F.when(held, F.col("most"))).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        now = (total - (row["held"] or 0.0)) / row["open"]
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level))).drop("most")


def position(share: Column, start: Column, end: Column) -> Column:
    """The time in 0..1 at which a source has been asked for this share of its target.

    Its demand is the integral of its weight, which goes in a straight line from start to end with mean 1:
    D(t) = start * t + (end - start) * t**2 / 2; this is D's inverse.
    """
    slope = end - start
    return F.when(slope == 0, share).otherwise(2 * share / (start + F.sqrt(F.greatest(start * start + 2 * slope * share, F.lit(0.0)))))


def placed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES, key: str = "doc_id", source: str = "source", text: str = "text", schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions.

    A position is a time: the share of the training that has gone when the source has been asked for so many tokens. A
    source of weight w is asked for w times its schedule's density at each time; as densities change, so does the rate of
    all sources together, and positions are not shares of the trained tokens.

    A document's size is its words (null text: 0). In each source, documents follow one another by the ids' md5; the
    sizes' running sums put each on the source's line of demand, which is gone through again when it ends (an epoch).
    A document is taken in an epoch if its middle lies within the target, so a source's taken words miss the target by
    half a document at most, and no document is taken more than most_times. positions: where in the training, 0 to 1,
    each copy comes. Rows that are equal in id, source and size may swap places. A null source is one of its own, the
    last; empty documents are never taken. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    rows = written(rows, "sizes")
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_s")
    ranked = spread_rank(rows.select("*", named), ["_s"], ["doc_id", "size"], "size")
    joined = ranked.join(sized.drop("source").join(sized.select("at", "source"), "at").select(named, "at", "source_size", "target"), "_s")
    middle = F.col("before") + F.col("size") / 2.0
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(most_times), F.greatest(F.lit(0), F.floor((F.col("target") - middle) / F.col("source_size")) + 1)))
    pick = lambda i: F.element_at(F.array(*(F.lit(float(x[i])) for x in schedules)), (F.col("at") % len(schedules) + 1).cast("int"))
    joined = joined.withColumn("copies", copies.cast("int")).withColumn("_a", pick(0)).withColumn("_e", pick(1))
    at = lambda i: position(F.least(F.lit(1.0), (middle + i * F.col("source_size")) / F.col("target")), F.col("_a"), F.col("_e"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return joined.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))


def ordered(copies: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The rows in the order of training: sorted by ranges of `at`, `k` and `nth`. Adds `place`, from 0 without gaps. Written; a range's rows are in its file in order."""
    by = ["at", "k", "nth"]
    rows = copies.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = written(rows.select(*keep, F.monotonically_increasing_id().alias("_m")), "ordered")  # a range's number, and the row's in it
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    held = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # a row a range
    starts, total = [], 0
    for part in sorted(held):
        starts.append((part, total))
        total += held[part]
    starts = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return rows.join(F.broadcast(starts), "_p").withColumn("place", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_m")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """What placed() gives, and `places`: where in the whole training order each copy comes, from 0 without gaps.

    The copies are range-sorted by position, then by the id's text and the copy's number; rows equal in all of that may
    swap places. Documents that aren't taken have none.
    """
    rows = written(placed(docs, weights, most_times, key, source, text).withColumn("_r", F.monotonically_increasing_id()), "plan")
    copies = rows.select("_r", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.posexplode("positions").alias("nth", "at"))
    found = ordered(copies.withColumn("at", F.round("at", 12)), ["_r"]).groupBy("_r").agg(F.sort_array(F.collect_list("place")).alias("places"))  # most_times at most
    out = rows.join(found, "_r", "left").drop("_r")
    return out.withColumn("places", F.coalesce("places", F.array().cast("array<long>")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents in the order of training: each as often as it is taken, range-sorted by position; the columns of docs.

    Null ids and sources are values of their own; null and empty texts have no words and are never taken; an empty table
    stays empty.

    Documents meet their positions by id, source and size. Only if rows repeat in these three are they numbered among
    their equals first, which takes a shuffle of the texts more.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))  # noqa: E731  never null
    by = ["k", "s", "z"]
    taken = written(placed(docs, weights, most_times, key, source, text).select(known(F.col("doc_id")).alias("k"), known(F.col("source")).alias("s"), F.col("size").alias("z"), "positions"), "positions")
    # the whole row as one column: whatever names it has, none clashes
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("d"), known(F.col(key)).alias("k"), known(F.col(source)).alias("s"), word_count(F.col(text)).alias("z"), F.col(text).alias("t"))
    if not taken.groupBy(*by).count().where("count > 1").isEmpty():
        taken = taken.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(F.size("positions").desc(), "positions")))
        rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("t")))
        by = [*by, "i"]
    out = rows.drop("t").join(taken.where(F.size("positions") > 0), by).select("d", "k", F.explode("positions").alias("at"))
    return out.repartitionByRange("at", "k").sortWithinPartitions("at", "k").select("d.*")
