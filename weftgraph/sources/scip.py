"""Binary code indexes: a protobuf wire reader for documents and their symbol occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "repo string, path string, pos int, symbol string, definition boolean, line int"
#: Fixed field numbers of the format: documents; path and occurrences; range, symbol, roles and typed ranges.
DOCUMENTS, PATH, OCCURRENCES, RANGE, SYMBOL, ROLES, TYPED = 2, 1, 2, 1, 2, 3, (8, 9)


def varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field number with its number or bytes; fixed-width fields are passed over."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        match tag & 7:
            case 0:
                value, at = varint(data, at)
                yield tag >> 3, value
            case 2:
                size, at = varint(data, at)
                yield tag >> 3, data[at : at + size]
                at += size
            case 1:
                at += 8
            case 5:
                at += 4
            case other:
                raise ValueError(f"wire type {other}")


def occurrences(data: bytes) -> Iterator[tuple[str, int, str, bool, int]]:
    """path, place, symbol, whether it defines, zero-based line; a typed range beats the packed one."""
    for number, document in fields(memoryview(data)):
        if number != DOCUMENTS or isinstance(document, int):
            continue
        parts = list(fields(document))
        path = next((bytes(v).decode("utf-8", "replace") for n, v in parts if n == PATH and not isinstance(v, int)), "")
        for pos, occurrence in enumerate(v for n, v in parts if n == OCCURRENCES and not isinstance(v, int)):
            symbol, roles, packed, typed = "", 0, None, None
            for n, v in fields(occurrence):
                if n == SYMBOL and not isinstance(v, int):
                    symbol = bytes(v).decode("utf-8", "replace")
                elif n == ROLES and isinstance(v, int):
                    roles = v
                elif n == RANGE and not isinstance(v, int) and len(v):
                    packed = varint(v, 0)[0]
                elif n in TYPED and not isinstance(v, int):
                    typed = next((x for k, x in fields(v) if k == 1 and isinstance(x, int)), None)
            line = packed if typed is None else typed
            if symbol and line is not None:
                yield path, pos, symbol, bool(roles & 1), line


def read_occurrences(files: DataFrame) -> DataFrame:
    """files(repo, path, content) -> one row per occurrence, lines from 1."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r, p, k, s, d, n + 1) for r, c in zip(frame["repo"], frame["content"], strict=True) for p, k, s, d, n in occurrences(bytes(c))]
            yield pd.DataFrame(rows, columns=["repo", "path", "pos", "symbol", "definition", "line"])

    return files.select("repo", "content").mapInPandas(run, SCHEMA)
