"""Rows of plain dictionaries out of Arrow-fed readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def read_files(files: DataFrame, schema: str, read: Callable[[str, str, bytes], list[dict]]) -> DataFrame:
    """``read(repo, path, content)`` for every file; a key that a row lacks is null."""
    ship(files.sparkSession)
    typed = pa.schema([(name, KINDS[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in read(repo, path, content)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in typed.names} for r in rows], schema=typed)

    return files.select("repo", "path", "content").mapInArrow(run, schema)
