"""A bounded cache of open versions: questions are routed by pin, a version in use is leased and outlives sweeps."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .catalog import Catalog, NoSuchVersion


class Reader(Catalog):
    """One version whose tables' places were read when it was opened; the log is not asked again."""

    def __init__(self, catalog: Catalog, version: str):
        super().__init__(catalog.spark, catalog.root, version)
        self._places = super()._tables()

    def version(self) -> str:
        return self.pinned

    def _tables(self) -> dict[str, str]:
        return self._places


@dataclass
class _Open:
    reader: Reader
    lease: str
    until: float
    users: int = 0


class Versions:
    """Readers of at most ``size`` versions, those in use beside; the one unused for longest is closed first."""

    def __init__(self, spark: SparkSession, root: str, size: int = 8, minutes: float = 60.0):
        self.spark, self.root, self.size, self.minutes = spark, root, size, minutes
        self._lock, self._open = threading.Lock(), OrderedDict()

    @contextmanager
    def reading(self, pin: str | None = None) -> Iterator[Reader]:
        """The version a pin names, or the newest as the log's head has it now; it is leased while in use."""
        catalog = Catalog(self.spark, self.root, pin)
        version = catalog.version()
        if version is None:
            raise NoSuchVersion(self.root)
        with self._lock:
            held = self._open.get(version)
            if held is None:
                lease = Catalog(self.spark, self.root, version).lease(self.minutes)
                try:
                    held = self._open[version] = _Open(Reader(catalog, version), lease, time.time() + self.minutes * 60)
                except Exception:
                    catalog.release(lease)
                    raise
            elif held.until - time.time() < self.minutes * 30:
                held.reader.renew(held.lease, self.minutes)
                held.until = time.time() + self.minutes * 60
            held.users += 1
            self._open.move_to_end(version)
            self._shrink(self.size)
        try:
            yield held.reader
        finally:
            with self._lock:
                held.users -= 1
                self._shrink(self.size)

    def _shrink(self, size: int) -> None:
        for version in [v for v, o in self._open.items() if not o.users]:
            if len(self._open) <= size:
                break
            gone = self._open.pop(version)
            gone.reader.release(gone.lease)

    def versions(self) -> list[str]:
        """Open versions, the one unused for longest first."""
        return list(self._open)

    def close(self) -> None:
        """Close what is not in use."""
        with self._lock:
            self._shrink(0)
