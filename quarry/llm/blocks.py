"""Documents in blocks, and the exchange of keys between blocks and buckets as packed arrays.

Operators that ask of each place in a text what the whole corpus knows of it (a count, a probability, whether it also
stands elsewhere) would shuffle a row for each place. Here a block of documents gathers its distinct keys, 64-bit
numbers, deals them to buckets by their highest bits, and sends each bucket one array. The bucket puts all blocks'
arrays together and answers each block with an array in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import written

#: Bytes of text in a block, but for a longer document.
BLOCK_BYTES = 4 << 20
#: What a document counts besides its text, so that a block of empty ones ends.
EACH_BYTES = 16
#: About so many bytes of text fall to a bucket.
BUCKET_BYTES = 16 << 20
#: From this size on, blocks grow with the root of the text and buckets with the root of that, as their product is what the shuffle's rows shrink by.
LARGE = 256 << 30
SENT = "block long, bucket int, kind int, keys binary, checks binary"


def packed(x: np.ndarray) -> bytes:
    """The array's bytes, compressed; unpacked() has to know its type."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), kind)


def sorted_packed(x: np.ndarray) -> bytes:
    """packed() for sorted 64-bit numbers: their differences, byte by byte, of which the upper ones are 0."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return packed(steps.view(np.uint8).reshape(-1, 8).T)


def sorted_unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(x, "u1").reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def scale(size: int) -> float:
    return max(1.0, size / LARGE) ** 0.5


def table_bytes(df: DataFrame) -> int:
    """What Spark takes the table's size for: its files, mostly."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def block_table(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_bytes, n_docs, docs: the key and text (null as empty) of a block's documents, compressed; written to the shared folder, so blocks stay as they are.

    Blocks have block_bytes of text; of tables over LARGE they are larger, some 60 MB at 100 TB, where workers need a few GB.
    """
    block_bytes = int(block_bytes * scale(table_bytes(docs.select(text))))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 32
        count, held, size = 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal count, held, size
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(whole)
            row = pa.RecordBatch.from_arrays([pa.array([start + count]), pa.array([size]), pa.array([whole.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "n_bytes", "n_docs", "docs"])
            count, held, size = count + 1, [], 0
            return row

        for batch in given:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64) + EACH_BYTES
            ends, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + (not held), int(np.searchsorted(ends, before + block_bytes - size, "right")))
                if to > at:
                    part = batch.slice(at, to - at)
                    held.append(pa.RecordBatch.from_arrays([part.column(key), pc.fill_null(part.column(text), "")], ["key", "text"]))
                    size += int(ends[to - 1]) - before
                    at = to
                if at < batch.num_rows or size >= block_bytes:
                    yield out()
        if held:
            yield out()

    return written(docs.select(key, text).mapInArrow(run, "block long, n_bytes long, n_docs long, docs binary"), "blocks")


def block_docs(docs: bytes) -> tuple[pa.Array, pa.Array]:
    """The keys and texts of a block."""
    whole = pa.ipc.open_stream(docs).read_all().combine_chunks()
    one = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return one(whole.column("key")), one(whole.column("text"))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, and where each starts, with the end."""
    binary = text.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, binary.offset * 8)
    data = binary.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def bucket_count(blocks: DataFrame) -> int:
    """A power of 2, in proportion to the text up to LARGE, and then to less."""
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return 1 << max(3, int(size / (BUCKET_BYTES * scale(size) ** 0.5)).bit_length())


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that have some of the sorted keys (unsigned, 64 bits), and which."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    at = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << shift)
    ends = [0, *at.tolist(), len(keys)]
    for bucket in range(buckets):
        if ends[bucket] < ends[bucket + 1]:
            yield bucket, slice(ends[bucket], ends[bucket + 1])


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them over all bits."""
    x = x.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (block, bucket, kind, keys, checks) as SENT."""
    block, bucket, kind, keys, checks = zip(*rows) if rows else ((),) * 5
    return rows_of({"block": (block, pa.int64()), "bucket": (bucket, pa.int32()), "kind": (kind, pa.int32()), "keys": (keys, pa.binary()), "checks": (checks, pa.binary())})


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The type in which a column of a table comes to and from Python, whatever it is."""
    return to_arrow_schema(df.select(df[f"`{column}`"]).schema).field(0).type


def per_block(blocks: DataFrame, run: Callable[[int, bytes], pa.RecordBatch], schema: str) -> DataFrame:
    def each(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs")):
                yield run(block, docs.as_py())

    return blocks.select("block", "docs").mapInArrow(each, schema)


def per_block_with(blocks: DataFrame, answers: DataFrame, run: Callable[[int, bytes, list[dict]], pa.RecordBatch], schema: str, empty: pa.Schema) -> DataFrame:
    """run gets each block with its answers by kind, then bucket."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        rows = sorted(right.to_pylist(), key=lambda x: (x["kind"], x["bucket"]))
        block = left.column("block")[0].as_py()
        return pa.Table.from_batches([run(block, left.column("docs")[0].as_py(), rows)]).cast(empty)

    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, schema)
