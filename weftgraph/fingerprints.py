"""Facts kept by the fingerprints of the files they were read from: reused, read again below what changed, or refused.

A file's fingerprint is the hash of its content. Every folder, up to the repository's root, has one too: the sum of
the hashes of (path below the folder, fingerprint) of all files in it, lane by lane, so that a tree of any shape is
made by one explode and one aggregation, combined before the exchange. Equal roots need no look at files; in
repositories whose roots differ, files are compared only in folders that differ.

Facts lie in segments. The table of leaves says which segment holds what is valid of a file, that of nodes which holds
what is valid of a repository as a whole; a refresh adds a segment of what it read. The log's entry is written last.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, ConcurrentCommit
from .sources import files as files_
from .sources import registry
from .sources.python_code import SCHEMA
from .sources.staging import Staging

LEAVES = "repo string, path string, folder string, hash string, size bigint, mtime bigint, seen bigint, segment int"
NODES = "repo string, node string, hash string, files bigint, bytes bigint, segment int"
FACTS = f"{SCHEMA}, adapter string, whole boolean, segment int"
#: Hexadecimal digits per lane of a folder's sum, and lanes: 240 of a hash's 256 bits, sums of 10^18 files fit a decimal.
DIGITS, LANES = 15, 4
#: Segments from which on a refresh writes what is valid as one.
MOST_SEGMENTS = 16
#: A file changed so shortly before it was looked at may change again without a new time of change.
RACY_NS = 2_000_000_000


class StaleFacts(RuntimeError):
    """Kept facts are not those of the files or of the readers at hand."""


def _folder(path: str = "path") -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def leaves(files: DataFrame) -> DataFrame:
    """files(repo, path, content), each path once in a repository -> repo, path, folder, hash, size; no content counts as empty."""
    content = F.coalesce("content", F.lit(b""))
    return files.select("repo", "path", _folder().alias("folder"), F.sha2(content, 256).alias("hash"), F.length(content).cast("bigint").alias("size"))


def nodes(leaves: DataFrame) -> DataFrame:
    """repo, node (folder; empty for the root), hash, files, bytes. A folder that moves keeps its hash."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.struct(F.array_join(F.slice(steps, 1, i), "/").alias("node"), F.array_join(F.slice(steps, i + 1, F.size(steps)), "/").alias("below")))
    rows = leaves.select("repo", "size", "hash", F.explode(above).alias("a")).select("repo", "a.node", "size", F.sha2(F.concat_ws("\0", "a.below", "hash"), 256).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(LANES)]
    made = rows.groupBy("repo", "node").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.concat_ws(",", *lanes).alias("sums"))
    return made.select("repo", "node", F.sha2(F.concat_ws(";", "sums", "files"), 256).alias("hash"), "files", "bytes")


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, node) of the nodes that are not the same in both trees."""
    return old.select("repo", "node", F.col("hash").alias("_old")).join(new.select("repo", "node", F.col("hash").alias("_new")), ["repo", "node"], "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("repo", "node")


def changes(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(leaves, nodes) of two states -> repo, path, change (added, changed, removed); files of equal folders are not compared."""
    folders = differing(old[1], new[1]).withColumnRenamed("node", "folder")
    side = lambda leaves, name: leaves.join(folders, ["repo", "folder"], "left_semi").select("repo", "path", F.col("hash").alias(name))
    both = side(old[0], "_old").join(side(new[0], "_new"), ["repo", "path"], "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("repo", "path", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))


def readers_signature(adapters: tuple) -> str:
    """Changes with the readers' names, versions and code: that of this library's readers and of the modules that other readers come from."""
    said = hashlib.sha256(FACTS.encode())
    for source in sorted(Path(files_.__file__).parent.glob("*.py")):
        said.update(source.read_bytes())
    for a in adapters:
        said.update(repr((a.name, a.version, a.each is None)).encode())
        for step in (a.read, a.applies, a.each, a.settle):
            if step is not None:
                try:
                    said.update(inspect.getsource(step).encode())
                except (OSError, TypeError):
                    said.update(getattr(step, "__qualname__", type(step).__qualname__).encode())
    return said.hexdigest()


class FactStore:
    """Kept facts of repositories under one root.

    Facts are valid for the content they were read from and for the readers that read them: with other readers
    nothing that is kept is used.
    """

    def __init__(self, spark: SparkSession, root: str, adapters: tuple = registry.ADAPTERS):
        self.spark, self.adapters, self.log = spark, adapters, Catalog(spark, root)
        self.root, self.signature = self.log.root, readers_signature(adapters)

    def _entry(self) -> dict | None:
        numbers = self.log._log()
        return self.log._entry(numbers[-1]) | {"number": numbers[-1]} if numbers else None

    def _table(self, entry: dict | None, name: str, schema: str) -> DataFrame:
        places = [] if entry is None or entry["readers"] != self.signature else entry[name]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in places)) if places else self.spark.createDataFrame([], schema)

    def _state(self, entry: dict | None, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Leaves and nodes of the repositories in ``scope`` (repo), or of all."""
        held = self._table(entry, "leaves", LEAVES), self._table(entry, "nodes", NODES)
        return held if scope is None else tuple(t.join(scope, "repo", "left_semi") for t in held)

    def _valid(self, entry: dict | None, scope: DataFrame | None = None) -> DataFrame:
        """What is valid of the kept facts, unsettled."""
        leaf, node = self._state(entry, scope)
        facts = self._table(entry, "facts", FACTS)
        of_files = facts.filter("not whole").join(leaf.select("repo", F.col("path").alias("file"), "segment"), ["repo", "file", "segment"], "left_semi")
        of_repos = facts.filter("whole").join(node.filter("node = ''").select("repo", "segment"), ["repo", "segment"], "left_semi")
        return of_files.select(*facts.columns).unionByName(of_repos.select(*facts.columns))

    def _settled(self, entry: dict | None, scope: DataFrame | None = None) -> DataFrame:
        facts = self._valid(entry, scope).drop("whole", "segment")
        return reduce(DataFrame.unionByName, (a.settle(facts.filter(F.col("adapter") == a.name)) for a in self.adapters), facts.filter("false"))

    def status(self, files: DataFrame) -> DataFrame:
        """repo, path, change of what differs from the kept state, in the repositories that ``files`` has."""
        new = leaves(files)
        return changes(self._state(self._entry(), files.select("repo").distinct()), (new, nodes(new)))

    def load(self, files: DataFrame) -> DataFrame:
        """Kept facts of the repositories in ``files``; any that are not those of these files and readers are an error. Nothing is parsed."""
        entry = self._entry()
        if entry is None or entry["readers"] != self.signature:
            raise StaleFacts("no facts are kept" if entry is None else "facts were read by other readers")
        scope = files.select("repo").distinct()
        roots = nodes(leaves(files)).filter("node = ''")
        off = differing(self._state(entry, scope)[1].filter("node = ''"), roots).groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("repo").alias("first")).first()
        if off["n"]:
            raise StaleFacts(f"{off['n']} repositories are not as they were read, the first is {off['first']}")
        return self._settled(entry, scope)

    def refresh(self, files: DataFrame) -> tuple[DataFrame, dict]:
        """Facts of the repositories in ``files`` as ``registry.discover`` gives them, and what was done; files that changed are parsed.

        The report has files, added, changed, removed and read (files parsed by readers of single files). Repositories
        that ``files`` does not have stay as they are kept.
        """
        staging = Staging(self.spark, "fingerprints")
        return self._kept(files, files.select("repo").distinct(), staging.save(leaves(files), "leaves"), staging)

    def refresh_folders(self, repos: DataFrame, **wanted) -> tuple[DataFrame, dict]:
        """Like ``refresh`` for repos(repo, root) on disk or in a store; files whose size and time of change are as they were are not opened.

        A file that had changed less than two seconds before it was looked at is opened again. The report's
        ``opened`` counts files read to be fingerprinted. ``wanted``: see ``files.listing``.
        """
        staging, now = Staging(self.spark, "fingerprints"), time.time_ns()
        repos = repos.select("repo", "root")
        listed = staging.save(files_.stamped(files_.listing(repos, **wanted)), "listed")
        held = self._state(self._entry(), repos.select("repo"))[0].filter(F.col("mtime") < F.col("seen") - RACY_NS).select("repo", "path", "size", "mtime", F.col("hash").alias("_hash"), F.col("seen").alias("_seen"))
        known = staging.save(listed.join(held, ["repo", "path", "size", "mtime"], "left"), "known")
        opened = leaves(files_.contents(known.filter("_hash is null"))).join(listed.select("repo", "path", "mtime"), ["repo", "path"]).withColumn("seen", F.lit(now))
        opened = staging.save(opened, "opened")
        same = known.filter("_hash is not null").select("repo", "path", _folder().alias("folder"), F.col("_hash").alias("hash"), "size", "mtime", F.col("_seen").alias("seen"))
        facts, report = self._kept(files_.contents(listed), repos.select("repo").distinct(), staging.save(same.unionByName(opened), "leaves"), staging)
        return facts, report | {"opened": opened.count()}

    def _kept(self, files: DataFrame, scope: DataFrame, new: DataFrame, staging: Staging) -> tuple[DataFrame, dict]:
        """Compare the new leaves with the kept ones, read what changed as a segment, and write the state; ``files`` is read for changed paths only."""
        entry = self._entry()
        usable = entry if entry is not None and entry["readers"] == self.signature else None
        scope = staging.save(scope, "scope")
        tree = staging.save(nodes(new), "nodes")
        old = self._state(usable, scope)
        found = staging.save(changes(old, (new, tree)), "changes")
        counts = {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        report = {"files": new.count(), **{c: counts.get(c, 0) for c in ("added", "changed", "removed")}}
        report["read"] = report["added"] + report["changed"]
        segment = 0 if entry is None else entry["number"] + 1
        at = f"{segment:010d}-{uuid.uuid4().hex[:6]}"
        if counts:
            # As it was read: an order by ranges would look at the rows, and parse the files, twice.
            read = self._read(files, found).withColumn("segment", F.lit(segment))
            read.select(*(f.split(" ")[0] for f in FACTS.split(", "))).write.parquet(f"{self.root}/facts/{at}")
        elif usable is not None and "seen" not in new.columns:
            return self._settled(usable, scope), report
        others = self._state(usable)
        stamps = [F.col(c) if c in new.columns else F.lit(None).cast("bigint").alias(c) for c in ("mtime", "seen")]
        leaf = new.select("repo", "path", "folder", "hash", "size", *stamps).join(old[0].select("repo", "path", "hash", "segment"), ["repo", "path", "hash"], "left").withColumn("segment", F.coalesce("segment", F.lit(segment)))
        node = tree.join(old[1].select("repo", "node", "hash", "segment"), ["repo", "node", "hash"], "left").withColumn("segment", F.coalesce("segment", F.lit(segment)))
        for name, mine, rest in (("leaves", leaf, others[0]), ("nodes", node, others[1])):
            self._write(rest.join(scope, "repo", "left_anti").select(*rest.columns).unionByName(mine.select(*rest.columns)), f"{name}/{at}")
        places = [*(usable["facts"] if usable else []), *([f"facts/{at}"] if counts else [])]
        made = {"readers": self.signature, "leaves": [f"leaves/{at}"], "nodes": [f"nodes/{at}"], "facts": places}
        if len(places) >= MOST_SEGMENTS:
            self._write(self._valid(made), f"facts/{at}-all")
            made["facts"] = [f"facts/{at}-all"]
        self._commit(segment, made)
        return self._settled(made, scope), report

    def _read(self, files: DataFrame, found: DataFrame) -> DataFrame:
        """Facts of changed files by readers of single files, and of changed repositories by the others."""
        of_files = files.join(found.filter("change <> 'removed'").select("repo", "path"), ["repo", "path"], "left_semi")
        of_repos = files.join(found.select("repo").distinct(), "repo", "left_semi")
        out = self.spark.createDataFrame([], f"{SCHEMA}, adapter string, whole boolean")
        for a in self.adapters:
            rows = a.read(a.applies(of_repos)) if a.each is None else a.each(a.applies(of_files))
            out = out.unionByName(rows.withColumns({"adapter": F.lit(a.name), "whole": F.lit(a.each is None)}), allowMissingColumns=True)
        return out

    def _write(self, rows: DataFrame, place: str) -> None:
        """In the order of repositories, so that row groups of others are skipped."""
        rows.repartitionByRange("repo").sortWithinPartitions("repo").write.parquet(f"{self.root}/{place}")

    def _commit(self, number: int, entry: dict) -> None:
        try:
            self.log._write_text(f"{self.root}/log/{number:010d}.json", json.dumps(entry, sort_keys=True), overwrite=False)
        except Exception as e:
            if number in self.log._log():
                raise ConcurrentCommit(f"state {number} was written meanwhile") from e
            raise

    def forget(self, repos: DataFrame) -> None:
        """Repositories (repo) of which nothing is kept any more."""
        entry = self._entry()
        if entry is None or entry["readers"] != self.signature:
            return
        at = f"{entry['number'] + 1:010d}-{uuid.uuid4().hex[:6]}"
        for name, rows in zip(("leaves", "nodes"), self._state(entry), strict=True):
            self._write(rows.join(repos.select("repo"), "repo", "left_anti").select(*rows.columns), f"{name}/{at}")
        self._commit(entry["number"] + 1, {k: entry[k] for k in ("readers", "facts")} | {"leaves": [f"leaves/{at}"], "nodes": [f"nodes/{at}"]})

    def sweep(self, keep_hours: float = 1.0) -> list[str]:
        """Remove places that the newest entry does not name and that are older than ``keep_hours``, and the entries before it."""
        entry, gone = self._entry(), []
        if entry is None:
            return gone
        for name in ("leaves", "nodes", "facts"):
            fs, p = self.log._fs(f"{self.root}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                place = f"{name}/{s.getPath().getName()}"
                if place not in entry[name] and s.getModificationTime() / 1000 < time.time() - keep_hours * 3600:
                    fs.delete(s.getPath(), True)
                    gone.append(place)
        for number in self.log._log():
            if number < entry["number"]:
                self.log._fs(self.root)[0].delete(self.log._fs(f"{self.root}/log/{number:010d}.json")[1], False)
        return sorted(gone)
