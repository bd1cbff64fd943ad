"""Vectors: normalising, exact cosine search, and embedding by a model that the caller gives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry.functions.terms import tokenize
from quarry.operators.bm25 import DIGITS, top

EPSILON = 1e-12
#: Query vectors that meet a batch of rows at once.
AT_ONCE = 256


class Model(Protocol):
    def encode(self, texts: Sequence[str], **kwargs: Any) -> Any: ...


class HashingModel:
    """Hashed token counts with signs: works offline, and is no learnt model."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            for token in tokenize(text):
                h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
                row[h % self.dimensions] += 1 - 2 * (h >> 63)
        return out


def embed_texts(model: Model, texts: Sequence[str]) -> np.ndarray:
    if not len(texts):
        return np.empty((0, 0), np.float32)
    try:
        found = model.encode(texts, use_multiprocessing=False)
    except TypeError:
        found = model.encode(texts)
    found = np.asarray(found, np.float32)
    if found.ndim != 2:
        raise ValueError("model.encode must return a two-dimensional array")
    return found


def embedded(rows: DataFrame, text: Column, model: Model) -> DataFrame:
    """Adds `embedding`; the model goes to the workers once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(given: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in given:
            yield pd.Series(list(embed_texts(model, x.tolist())))

    return rows.withColumn("embedding", run(text))


def normalized(vector: Column) -> Column:
    """The vector over its length, as doubles; a zero vector stays."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.transform(F.array(F.greatest(F.sqrt(squares), F.lit(EPSILON))), lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


def cosine_top(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, key: str = "chunk_ord", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, score: the k rows nearest by cosine, weak and negative ones too; ties go to the lower key.

    A stated set of query vectors, which goes to all workers, against all rows: each batch of rows meets AT_ONCE queries in a
    matrix product, of which each query's k best rows go on, so the shuffle has k rows a query and batch.
    """
    ids = np.array([q for q, _ in queries], np.int64)
    asked = np.array([v for _, v in queries], np.float64).reshape(len(ids), -1)
    asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), EPSILON)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            keys = np.asarray(batch.column(0), np.int64)
            flat = np.asarray(batch.column(1).flatten(), np.float64)
            if not len(keys) or not len(ids):
                continue
            if len(flat) != len(keys) * asked.shape[1]:
                raise ValueError("query vector dimension does not match index dimension")
            rows = flat.reshape(len(keys), -1)
            unit = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), EPSILON)).T
            for at in range(0, len(ids), AT_ONCE):
                found = np.round(asked[at : at + AT_ONCE] @ unit, DIGITS)
                order = np.lexsort((np.broadcast_to(keys, found.shape), -found), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + AT_ONCE], order.shape[1])), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(found, order, 1).ravel())], ["query_id", key, "score"])

    found = vectors.select(F.col(key).cast("long").alias(key), F.col(vector)).mapInArrow(run, f"query_id long, {key} long, score double")
    return top(found, k, ["query_id"], [key]).select("query_id", "rank", key, "score")
