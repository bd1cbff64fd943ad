"""A directory tree of source files as chunks.

Spark's own file sources leave out names that begin with a dot or underscore, so the tree is listed here: names and sizes
on the driver, contents by the workers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import CHUNK_COLUMNS, IGNORED_DIRS, MOST_FILE_BYTES, SUFFIXES
from quarry.sources.chunker import chunk_files, suffix_of


def listed(root: str, suffixes: Sequence[str] | None = None) -> Iterator[tuple[str, int]]:
    """Paths relative to the root and sizes, directories and files in the order of their names; no links, no ignored directories."""
    wanted = tuple(x.lower() for x in suffixes or SUFFIXES)
    todo = [Path(root)]
    while todo:
        path = todo.pop()
        if path.is_symlink():
            continue
        if path.is_dir():
            if path == Path(root) or path.name not in IGNORED_DIRS:
                todo += sorted(path.iterdir(), key=lambda p: p.name, reverse=True)
        elif path.is_file() and suffix_of(path.name) in wanted:
            try:
                yield path.relative_to(root).as_posix(), os.stat(path).st_size
            except OSError:
                continue


def checked_root(root: str) -> str:
    path = Path(root).expanduser().resolve()
    if not path.exists():
        raise FileNotFoundError(f"Path does not exist: {path}")
    if not path.is_dir():
        raise NotADirectoryError(f"Path is not a directory: {path}")
    return str(path)


def read_files(files: DataFrame, root: str) -> DataFrame:
    """file_ord, content, file_path: as UTF-8, bad bytes replaced, line ends made \\n; unreadable and blank files are left out."""

    def run(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in given:
            rows = []
            for order, path in zip(frame["file_ord"], frame["file_path"]):
                try:
                    text = Path(root, path).read_text(encoding="utf-8", errors="replace")
                except OSError:
                    continue
                if text.strip():
                    rows.append((order, text, path))
            yield pd.DataFrame(rows, columns=["file_ord", "content", "file_path"])

    return files.select("file_ord", "file_path").mapInPandas(run, "file_ord long, content string, file_path string")


def scan(spark: SparkSession, root: str, suffixes: Sequence[str] | None = None) -> DataFrame:
    """chunk_ord and CHUNK, numbered in the order of the tree. Files above MOST_FILE_BYTES are left out before they are read."""
    root = checked_root(root)
    rows = [(i, p) for i, (p, size) in enumerate(listed(root, suffixes)) if size <= MOST_FILE_BYTES]
    files = spark.createDataFrame(rows, "file_ord long, file_path string").repartition(max(1, min(len(rows) // 16 + 1, 4096)))
    found = chunk_files(read_files(files, root))
    # a file of a million bytes has fewer chunks than that: order by file, then place
    return found.select((F.col("file_ord") * F.lit(1 << 20) + F.col("nth")).alias("chunk_ord"), *CHUNK_COLUMNS)
