"""What the operators of this subpackage share: the shared folder, batches, and ranks without large groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.reach import reach
from quarry.shared import written

__all__ = ["batches", "spread_rank", "table", "texts", "word_count", "word_lists", "written"]

#: A batch of texts that Python holds at once has so many bytes, or one document.
BATCH_BYTES = 2 << 20
#: Parts into which spread_rank deals each group.
RANK_BUCKETS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def batches(given: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many bytes of text and so many rows, or of one row; none is empty."""
    for batch in given:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts; null counts as empty."""
    return pc.fill_null(batch.column(text), "").to_pylist()


def word_lists(batch: pa.RecordBatch, text: str = "text") -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all rows after one another, and how many each row has. Null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(text), ""))
    words, counts = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
    there = np.asarray(pc.binary_length(words), np.int64) > 0
    if not there.all():
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[there], minlength=len(counts))
        words = words.filter(pa.array(there))
    return words, counts


def word_count(text: Column) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def spread_rank(df: DataFrame, keys: Sequence[str], tie: Sequence[str], value: str | None = None, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds `rank` (from 0, gapless within the keys) and, with a value, `before` (the sum of the value over the rows of lower rank).

    Rows are ordered by the md5 of the first tie column, then by all tie columns. A group is dealt into parts by the
    first digits of the md5; the parts' counts are summed in order, and only one part's rows meet in a task, so a key
    with a third of all rows is split. keys must hold no nulls. Rows equal in all tie columns may swap ranks.
    """
    digits = len(f"{buckets - 1:x}")
    rows = df.withColumn("_h", F.md5(F.coalesce(F.col(tie[0]).cast("string"), F.lit("")))).withColumn("_b", F.substring("_h", 1, digits))
    part = [*keys, "_b"]
    held = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.sum(value or F.lit(0)).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"))
    inside = Window.partitionBy(*part).orderBy("_h", *tie)
    out = rows.join(starts, part).withColumn("rank", (F.col("_n0") + F.row_number().over(inside) - 1).cast("long"))
    if value:
        out = out.withColumn("before", F.col("_v0") + F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_h", "_b", "_n0", "_v0")
