"""A versioned catalog of objects, edges, enrichments and build metadata on Parquet.

A change writes the tables it touches below a new version directory and then adds one numbered entry to the
log, by a rename that fails if the number is taken: readers take the highest entry and see a whole version,
of two concurrent changes the second is refused. An entry says where each table of its version stands, so
tables that did not change are not written again. Tables are written in the order of the key by which they are
looked up, so that a point or a prefix reads few files, and with Bloom filters on it. Spark has neither MERGE on Parquet nor foreign keys: upserts are a union with the newest row per key,
deletes and cascades are anti joins.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGES, ENRICHMENTS, META, OBJECTS

#: Edges that are products, kept as their factors: each group's ``from_id`` has an edge to each member of its class but itself and those ``apart``, which stand among the other edges.
FACTORS = {"groups": "from_id string, relationship string, source string, confidence string, via_paths array<string>, apart array<string>, cls string, pairs long", "members": "cls string, to_id string"}
#: Pairs that one task makes of groups.
PAIRS = 4_000_000
TABLES = {"objects": (OBJECTS, "object_type"), "edges": (EDGES, "relationship"), "enrichments": (ENRICHMENTS, None), "meta": (META, None)}
#: Lookup tables, made of the objects of one version and refused for any other: names in order, and the trigrams of ids.
LOOKUPS = {"names": "object_type string, name string, id string, source string", "postings": "object_type string, gram string, id string", "grams": "object_type string, gram string, n long"}
#: Per table the columns by which its files are ranged and sorted, the first of them with a Bloom filter.
ORDER = {"objects": ("id",), "edges": ("from_id", "to_id"), "groups": ("from_id", "cls"), "members": ("to_id", "cls"), "enrichments": ("object_id",), "names": ("name", "id"), "postings": ("gram", "id"), "grams": ("gram",)}
EDGE_KEY = ["from_id", "relationship", "to_id", "source"]
SCHEMA_VERSION = "1"


class ConcurrentCommit(RuntimeError):
    """Another change was committed since this one read the catalog."""


class NoSuchVersion(LookupError):
    """The version or pin a reader asks for does not exist."""


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces ``old`` by key; of repeated new rows that with the least content stays."""
    whole = F.struct(*(F.col(f"`{c}`") for c in old.columns))
    one = new.groupBy(*keys).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*").select(*old.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(one)


def delete_scope(objects: DataFrame, edges: DataFrame, enrichments: DataFrame, exact: list[str], prefixes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the named ids and those below the literal prefixes; edges at them and their enrichments go too."""
    gone = F.col("id").isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        gone = gone | F.col("id").startswith(p)
    ids = objects.filter(gone).select("id")
    return (
        objects.filter(~gone),
        edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*edges.columns),
        enrichments.join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_anti").select(*enrichments.columns),
    )


def replace_edges(edges: DataFrame, source: str, scope: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of ``source`` that start in ``scope`` (id) make way for ``new``; an empty scope only inserts."""
    old = edges.filter(F.col("source") == source).join(scope.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    kept = edges.filter(F.col("source") != source).unionByName(old.select(*edges.columns))
    return upsert(kept, new, EDGE_KEY)


def stubs(ids: DataFrame, objects: DataFrame, reason: str = "referenced") -> DataFrame:
    """Placeholder objects for ids that have none."""
    new = ids.select("id").distinct().join(objects.select("id"), "id", "left_anti")
    return new.select(
        "id", F.substring_index("id", ":", 1).alias("object_type"), F.element_at(F.split("id", ":"), 2).alias("slug"), F.element_at(F.split("id", ":", 2), -1).alias("name"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("version"), F.lit("relationship_stub").alias("source"), F.lit("stub").alias("generation_strategy"),
        F.lit(None).cast("timestamp").alias("last_generated_at"), F.to_json(F.struct(F.lit(True).alias("stub"), F.lit(reason).alias("reason"))).alias("payload"))


def factored(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The edges that groups stand for, made by as many tasks as the groups have files."""
    met = groups.repartition(max(1, len(groups.inputFiles())), "from_id", "cls").join(members, "cls")
    own = (F.col("to_id") != F.col("from_id")) & (F.col("apart").isNull() | ~F.array_contains("apart", F.col("to_id")))
    kinds = (f.split(" ", 1) for f in EDGES.split(", "))
    return met.filter(own).select(*(F.col(c) if c in met.columns else F.lit(None).cast(k).alias(c) for c, k in kinds))


def merge_shas(old: dict[str, str], new: dict[str, str | None]) -> dict[str, str]:
    """Commits by repository; a missing commit removes that repository's entry."""
    return {k: v for k, v in (old | new).items() if v}


class Catalog:
    """One catalog directory; ``version`` pins a reader to a version or a named pin."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None):
        self.spark, self.root, self.pinned = spark, root.rstrip("/"), version

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str, overwrite: bool = True) -> None:
        """Write beside ``path`` and rename over it, or to it if nothing may stand there; readers see the old text or the new."""
        fs, p = self._fs(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, target = self.spark._jvm, self._fs(path)[1]
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if overwrite else rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(p, target, how)
        except Exception:
            fs.delete(p, False)
            raise

    def _log(self) -> list[int]:
        """Numbers of the log's entries, ascending."""
        fs, p = self._fs(f"{self.root}/log")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _entry(self, number: int) -> dict:
        return json.loads(self._read_text(f"{self.root}/log/{number:010d}.json"))

    def version(self) -> str | None:
        """The pinned version, the one a pin's record names, or the newest; None for a catalog without any."""
        if self.pinned:
            record = self._read_text(f"{self.root}/pins/{self.pinned}.json")
            return json.loads(record)["version"] if record else self.pinned
        log = self._log()
        return self._entry(log[-1])["version"] if log else None

    def _tables(self) -> dict[str, str]:
        """Where the tables of this reader's version stand."""
        log = self._log()
        if not self.pinned:
            return self._entry(log[-1])["tables"] if log else {}
        version = self.version()
        for number in reversed(log):
            entry = self._entry(number)
            if entry["version"] == version:
                return entry["tables"]
        raise NoSuchVersion(self.pinned)

    def table(self, name: str) -> DataFrame:
        """A table of the version, empty where that never had one; a version that does not exist is an error."""
        held = self._tables()
        rows = self._stored(held.get(name), TABLES[name][0])
        factors = self._factors(held) if name == "edges" else None
        return rows if factors is None else rows.unionByName(factored(*factors))

    def _stored(self, at: str | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(f"{self.root}/{at}")

    def _factors(self, held: dict[str, str], prefix: str = "") -> tuple[DataFrame, DataFrame] | None:
        """Groups and members; None if all edges stand by themselves."""
        return tuple(self._stored(held[prefix + name], schema) for name, schema in FACTORS.items()) if f"{prefix}groups" in held else None

    def edge_parts(self) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
        """The edges of this version that no group stands for, and its groups and members if it has any."""
        held = self._tables()
        return self._stored(held.get("edges"), EDGES), self._factors(held)

    def place(self, name: str) -> str | None:
        """Where a table of this version stands; two versions with one place have one table."""
        return self._tables().get(name)

    def linked(self) -> dict[str, DataFrame] | None:
        """The objects that were linked last and the edges as they were then; None before the first linking."""
        held = self._tables()
        if not {"linked_objects", "linked_edges"} <= set(held):
            return None
        rows = {name: self._stored(held[f"linked_{name}"], TABLES[name][0]) for name in ("objects", "edges")}
        factors = self._factors(held, "linked_")
        return rows if factors is None else rows | {"edges": rows["edges"].unionByName(factored(*factors))}

    def commit(self, linked: str | None = None, **tables: DataFrame) -> str:
        """Write the given tables as a new version; the others stay where they are, but ``edges`` takes the place of groups too unless new ones (``groups``, ``members``) come with it.

        ``linked`` is the place of the objects out of which the version's edges were linked: the log keeps it, and
        with it the table, until the next linking.
        """
        if self.pinned:
            raise NoSuchVersion("a pinned reader does not write")
        log = self._log()
        number, held = (log[-1] + 1, self._entry(log[-1])["tables"]) if log else (0, {})
        at = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"
        for name, df in tables.items():
            self._write(name, df, f"{self.root}/versions/{at}/{name}")
        held = {name: place for name, place in held.items() if not ("edges" in tables and name in FACTORS or linked is not None and name.startswith("linked_"))}
        entry = {"version": at, "tables": held | {name: f"versions/{at}/{name}" for name in tables}}
        if linked is not None:
            entry["tables"] |= {"linked_objects": linked} | {f"linked_{name}": place for name, place in entry["tables"].items() if name in ("edges", *FACTORS)}
        if set(tables) & set(LOOKUPS):
            entry["of"] = held.get("objects")
        elif log and "of" in self._entry(log[-1]):
            entry["of"] = self._entry(log[-1])["of"]
        try:
            self._write_text(f"{self.root}/log/{number:010d}.json", json.dumps(entry, sort_keys=True), overwrite=False)
        except Exception as e:
            if number in self._log():
                raise ConcurrentCommit(f"version {number} was committed meanwhile") from e
            raise
        return at

    def _write(self, name: str, df: DataFrame, path: str) -> None:
        """In the order of its key within its partition, so that the files and row groups that a lookup can skip are known by their bounds."""
        partition, order = (TABLES[name][1] if name in TABLES else None if name in FACTORS else "object_type"), ORDER.get(name, ())
        by = [c for c in (partition, *order) if c]
        tasks = [-(-(df.agg(F.sum("pairs")).first()[0] or 1) // PAIRS)] if name == "groups" else []
        rows = df.repartitionByRange(*tasks, *by).sortWithinPartitions(*by) if by else df
        out = rows.write.option("parquet.block.size", 32 << 20)
        for c in (*order[:1], *(("to_id",) if name == "edges" else ())):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (out.partitionBy(partition) if partition else out).parquet(path)

    def build_lookup(self) -> str:
        """Names and trigrams of the current objects as tables of their own; any later change of the objects makes them stale."""
        from .operators.lookup import gram_counts, names, postings

        objects = self.table("objects")
        grams = postings(objects)
        return self.commit(names=names(objects), postings=grams, grams=gram_counts(grams))

    def lookup(self) -> dict[str, DataFrame] | None:
        """The lookup tables of this version; None if there are none or they were made of other objects."""
        log = self._log()
        version = self.version()
        entry = next((e for n in reversed(log) if (e := self._entry(n))["version"] == version), {})
        held = entry.get("tables", {})
        if not entry.get("of") or entry["of"] != held.get("objects"):
            return None
        return {name: self.spark.read.schema(schema).parquet(f"{self.root}/{held[name]}") for name, schema in LOOKUPS.items()}

    def upsert_objects(self, new: DataFrame) -> str:
        return self.commit(objects=upsert(self.table("objects"), new, ["id"]))

    def upsert_enrichments(self, new: DataFrame) -> str:
        return self.commit(enrichments=upsert(self.table("enrichments"), new, ["object_id", "model"]))

    def delete(self, exact: list[str] = (), prefixes: list[str] = ()) -> str:
        objects, edges, enrichments = delete_scope(self.table("objects"), self.table("edges"), self.table("enrichments"), list(exact), list(prefixes))
        return self.commit(objects=objects, edges=edges, enrichments=enrichments)

    def replace_edges(self, source: str, scope: DataFrame, new: DataFrame) -> str:
        return self.commit(edges=replace_edges(self.table("edges"), source, scope, new))

    def load_snapshot(self, prefix: str, objects: DataFrame, edges: DataFrame | None = None) -> str:
        """Clear what stands below ``prefix``, insert, and keep only edges whose ends exist."""
        kept, held, enrichments = delete_scope(self.table("objects"), self.table("edges"), self.table("enrichments"), [], [prefix])
        every = upsert(kept, objects, ["id"])
        if edges is not None:
            from .operators.resolve import valid_edges

            held = upsert(held, valid_edges(edges, every).select(*held.columns), EDGE_KEY)
        return self.commit(objects=every, edges=held, enrichments=enrichments)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.table("meta").collect()}  # a handful of rows by construction

    def stamp(self, shas: dict[str, str | None]) -> str:
        held = self.meta()
        merged = merge_shas(json.loads(held.get("repo_shas", "{}")), shas)
        now = datetime.now(UTC)
        rows = held | {"build_id": f"{now:%Y%m%dT%H%M%SZ}", "built_at": now.isoformat(timespec="seconds"), "schema_version": SCHEMA_VERSION, "repo_shas": json.dumps(merged, sort_keys=True)}
        return self.commit(meta=self.spark.createDataFrame(sorted(rows.items()), META))

    # Pins: named versions with an expiry.

    def pin(self, alias: str, days: int = 30, reason: str = "", owner: str = "") -> dict:
        import re

        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,62}", alias):
            raise ValueError(f"invalid alias: {alias!r}")
        now = datetime.now(UTC)
        record = {"alias": alias, "version": self.version(), "created_at": now.isoformat(timespec="seconds"), "expires_at": (now + timedelta(days=days)).isoformat(timespec="seconds"), "reason": reason, "owner": owner}
        self._write_text(f"{self.root}/pins/{alias}.json", json.dumps(record))
        return record

    def pins(self) -> list[dict]:
        """Pins by creation time with the days they have left; malformed records are passed over."""
        fs, p = self._fs(f"{self.root}/pins")
        out = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            try:
                record = json.loads(self._read_text(status.getPath().toString()))
                left = (datetime.fromisoformat(record["expires_at"]).timestamp() - time.time()) / 86400
                out.append(record | {"days_left": max(0, -int(-left // 1))})
            except (ValueError, KeyError):
                continue
        return sorted(out, key=lambda r: r["created_at"])

    def extend(self, alias: str, days: int) -> dict:
        record = json.loads(self._read_text(f"{self.root}/pins/{alias}.json") or "{}")
        record["expires_at"] = (datetime.fromisoformat(record["expires_at"]) + timedelta(days=days)).isoformat(timespec="seconds")
        self._write_text(f"{self.root}/pins/{alias}.json", json.dumps(record))
        return record

    def unpin(self, alias: str) -> bool:
        fs, p = self._fs(f"{self.root}/pins/{alias}.json")
        return bool(fs.delete(p, False))

    # Leases: versions in use, for a while.

    def lease(self, minutes: float = 60.0) -> str:
        """Keep this reader's version from sweeps for some minutes; the lease's path, to renew or release it by."""
        version = self.version()
        path = f"{self.root}/leases/{version}.{uuid.uuid4().hex[:8]}.json"
        self.renew(path, minutes)
        if version not in {self._entry(n)["version"] for n in self._log()}:
            self.release(path)
            raise NoSuchVersion(str(version))
        return path

    def renew(self, lease: str, minutes: float = 60.0) -> None:
        version = lease.rsplit("/", 1)[-1].split(".")[0]
        self._write_text(lease, json.dumps({"version": version, "expires_at": time.time() + minutes * 60}))

    def release(self, lease: str) -> bool:
        return bool(self._fs(lease)[0].delete(self._fs(lease)[1], False))

    def _leased(self) -> set[str]:
        """Versions under a lease that has not run out; leases that have are removed, malformed ones passed over."""
        fs, p = self._fs(f"{self.root}/leases")
        out = set()
        for status in fs.listStatus(p) if fs.exists(p) else []:
            path = status.getPath().toString()
            try:
                record = json.loads(self._read_text(path) or "{}") if path.endswith(".json") else {}
                if record["expires_at"] >= time.time():
                    out.add(record["version"])
                else:
                    self.release(path)
            except (ValueError, KeyError):
                continue
        return out

    def sweep(self, keep_hours: float = 1.0) -> list[str]:
        """Drop expired pins, then versions that are neither newest, pinned, leased nor younger than ``keep_hours``, and tables none of the rest uses.

        Leases are read again between the log's entries and the tables: a reader that saw its version's entry after
        it had taken its lease finds the tables.
        """
        for record in self.pins():
            if datetime.fromisoformat(record["expires_at"]) < datetime.now(UTC):
                self.unpin(record["alias"])
        log = self._log()
        entries = {n: self._entry(n) for n in log}
        pinned = {r["version"] for r in self.pins()} | self._leased()
        old = time.time() - keep_hours * 3600
        fs, p = self._fs(f"{self.root}/versions")
        ages = {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}
        live = {n for n, e in entries.items() if n == log[-1] or e["version"] in pinned or ages.get(e["version"], 0) >= old}
        used = {place.split("/")[1] for n in live for place in entries[n]["tables"].values()}
        for n in log:
            if n not in live:
                fs.delete(self._fs(f"{self.root}/log/{n:010d}.json")[1], False)
        leased = self._leased()
        used |= {place.split("/")[1] for e in entries.values() if e["version"] in leased for place in e["tables"].values()}
        gone = sorted(name for name, age in ages.items() if name not in used and age < old)
        for name in gone:
            fs.delete(self._fs(f"{self.root}/versions/{name}")[1], True)
        return gone

    def plan_forget(self, repos: list[str]) -> DataFrame:
        """(id, slug) of services and libraries that go with the named repositories: by slug, else by a segment of their root."""
        rows = self.table("objects").filter(F.col("object_type").isin("service", "library"))
        names = self.spark.createDataFrame([(r,) for r in repos], "repo string")
        root = F.get_json_object("payload", "$.root")
        tagged = rows.select("id", "slug", F.split(root, "/").alias("_segments"))
        return tagged.join(F.broadcast(names), (F.col("slug") == F.col("repo")) | F.array_contains("_segments", F.col("repo")), "left_semi").select("id", "slug")

    def forget(self, repos: list[str], relink=None) -> dict:
        """Remove the repositories as if they had never been indexed, and say what went.

        Services whose repository is not named survive, also below one whose name begins alike. ``relink``
        (catalog) resolves the edges of the rest anew; if it fails the removal stands. Commits of the
        repositories leave the stamp.
        """
        plan = self.plan_forget(repos).collect()  # services of the named repositories only
        if not plan:
            return {"removed": [], "relinked": False}
        exact = [r["id"] for r in plan]
        prefixes = [f"{kind}:{r['slug']}:" for r in plan for kind in ("interface", "code_symbol")]
        self.delete(exact, prefixes)
        done = False
        if relink is not None:
            try:
                relink(self)
                done = True
            except Exception:  # noqa: BLE001  best effort: the index without the repositories is whole
                done = False
        self.stamp(dict.fromkeys([*repos, *(r["slug"] for r in plan)]))
        return {"removed": sorted(exact), "relinked": done}


def latest(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The newest row of each key; of rows with one stamp that with the least content."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*keys).agg(F.min_by(whole, F.struct((-F.unix_micros(stamp)).alias("t"), F.to_json(whole))).alias("_row")).select("_row.*")
