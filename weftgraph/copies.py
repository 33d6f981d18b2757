"""Verifiable copies of a catalog's version under another root.

A copy is made in an order that leaves the old copy or the new one at every moment: tables below a folder of their
own, then a manifest of their files and content, last the log's entry by which readers find it. What a broken
attempt left stands in no entry and goes with the next sweep.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FACTORS, LOOKUPS, TABLES, Catalog, NoSuchVersion


class TornCopy(RuntimeError):
    """A copy is not what its manifest says, or has none."""


def content(rows: DataFrame) -> list:
    """Number of rows and the sum of their hashes: equal for equal tables in any order, in one pass without an exchange of rows."""
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(whole).cast("decimal(20,0)")).alias("h")).first()
    return [r["n"], str(r["h"] or 0)]


def _read(catalog: Catalog, name: str, place: str) -> DataFrame:
    return catalog.spark.read.schema(TABLES[name][0] if name in TABLES else (FACTORS | LOOKUPS)[name]).parquet(f"{catalog.root}/{place}")


def _files(catalog: Catalog, place: str) -> dict[str, int]:
    """Files below a place by name, with their lengths; none if it is gone."""
    fs, p = catalog._fs(f"{catalog.root}/{place}")
    out: dict[str, int] = {}
    if fs.exists(p):
        below, head = fs.listFiles(p, True), len(fs.resolvePath(p).toString()) + 1
        while below.hasNext():
            f = below.next()
            if f.getPath().getName().endswith(".parquet"):
                out[f.getPath().toString()[head:]] = f.getLen()
    return out


def copy_out(catalog: Catalog, root: str) -> str:
    """Copy the reader's version to ``root`` as its newest version and return that; a table that does not arrive whole is an error.

    What was linked last is not copied: the first linking of a copy links all.
    """
    if catalog.version() is None:
        raise NoSuchVersion("there is no version to copy")
    target, manifest = Catalog(catalog.spark, root), {}
    at = f"{catalog.version()}-{uuid.uuid4().hex[:6]}"
    held = {name: place for name, place in catalog._tables().items() if not name.startswith("linked_")}
    current = catalog.lookup() is not None
    for name, place in sorted(held.items()):
        if name in LOOKUPS and not current:
            continue  # made of other objects
        rows, to = _read(catalog, name, place), f"versions/{at}/{name}"
        target._write(name, rows, f"{target.root}/{to}")
        manifest[name] = {"place": to, "content": content(rows), "files": _files(target, to)}
        if content(_read(target, name, to)) != manifest[name]["content"]:
            raise TornCopy(f"{name} did not arrive whole")
    target._write_text(f"{target.root}/manifests/{at}.json", json.dumps(manifest, sort_keys=True))
    entry = {"version": at, "tables": {name: m["place"] for name, m in manifest.items()}}
    if current:
        entry["of"] = entry["tables"]["objects"]
    log = target._log()
    target._write_text(f"{target.root}/log/{(log[-1] + 1 if log else 0):010d}.json", json.dumps(entry, sort_keys=True), overwrite=False)
    return at


def open_copy(spark: SparkSession, root: str, whole: bool = False) -> Catalog:
    """A reader of the newest copy, pinned to it; one whose files differ from its manifest is refused.

    Names and lengths of files are always compared, with ``whole`` the content of every table too.
    """
    version = Catalog(spark, root).version()
    if version is None:
        raise NoSuchVersion(root)
    held = Catalog(spark, root, version)
    text = held._read_text(f"{held.root}/manifests/{version}.json")
    if text is None:
        raise TornCopy(f"{version} has no manifest")
    for name, m in json.loads(text).items():
        if _files(held, m["place"]) != m["files"] or whole and content(_read(held, name, m["place"])) != m["content"]:
            raise TornCopy(f"{name} of {version} is not what was copied")
    return held
