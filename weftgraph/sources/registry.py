"""The interfaces of a repository out of the facts of all readers: mounts followed, repeats merged, ids unique.

A reader (``Adapter``) turns files(repo, path, content) into facts; facts of all languages share one shape, so
what follows knows no language. Readers can be added by passing a longer list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import join_path, path_slug, reversion
from ..operators.graph import compose_prefixes, resolve_aliases
from ..operators.lookup import unique_ids
from . import files as files_
from .python_code import SCHEMA, read_python
from .script_code import read_each_script, read_scripts, settle_scripts
from .symbol_code import read_symbols
from .staging import Staging


@dataclass(frozen=True)
class Adapter:
    """A named reader of facts; ``applies`` narrows the files it is given.

    ``each`` gives facts that depend on one file only, out of which ``settle`` makes those of ``read``: such a reader
    reads changed files alone where facts are kept. One without ``each`` reads whole repositories then. Kept facts are
    read anew when ``version`` changes.
    """

    name: str
    read: Callable[[DataFrame], DataFrame]
    applies: Callable[[DataFrame], DataFrame] = lambda files: files
    each: Callable[[DataFrame], DataFrame] | None = None
    settle: Callable[[DataFrame], DataFrame] = lambda facts: facts
    version: str = ""


ADAPTERS = (Adapter("python", read_python, each=read_python), Adapter("script", read_scripts, each=read_each_script, settle=settle_scripts), Adapter("symbols", read_symbols, each=read_symbols))
#: Which kind of reader owns a path first: order of precedence.
KINDS = ("web", "express", "rails", "messaging")


def discover(files: DataFrame, adapters: tuple[Adapter, ...] = ADAPTERS) -> DataFrame:
    """Facts of all readers, with ``adapter``; columns a reader lacks are null."""
    empty = files.sparkSession.createDataFrame([], f"{SCHEMA}, adapter string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (a.read(a.applies(files)).withColumn("adapter", F.lit(a.name)) for a in adapters), empty)


def with_channels(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with the channels of configuration where messaging is known to happen."""
    channels = files_.config_channels(files_.config_values(files.filter(_is_config(F.col("path")))))
    events = files_.messaging_interfaces(facts, channels, files_.messaging_dependencies(files))
    return facts.filter("fact <> 'event'").unionByName(events, allowMissingColumns=True)


def _is_config(path: Column) -> Column:
    globs = "|".join(g.replace(".", r"\.").replace("*", "[^/]*") for g in (*files_.CONFIG_NAMES, *files_.CONFIG_MODULES))
    return path.rlike(f"(^|/)({globs})$") & (F.size(F.split(path, "/")) <= F.when(path.endswith(".py"), 2).otherwise(3))


def _key(repo: str, name: str) -> Column:
    return F.concat_ws("#", repo, name)


def _known_places(references: DataFrame, keys: DataFrame) -> DataFrame:
    """references(repo, name) -> (repo, name, key): the key itself, else the one key of the repository that ends in the name.

    Packages below a source folder are imported without it. Tails are met by equality; a name that several
    keys end in stays unresolved.
    """
    tail = F.explode(F.transform(F.sequence(F.lit(1), F.size("_s")), lambda i: F.array_join(F.slice("_s", i, F.size("_s")), ".")))
    tails = keys.select("repo", "name").distinct().withColumn("_s", F.split("name", r"\.")).select("repo", F.col("name").alias("key"), tail.alias("name"))
    met = references.select("repo", "name").distinct().join(tails, ["repo", "name"])
    found = met.groupBy("repo", "name").agg(F.bool_or(F.col("key") == F.col("name")).alias("_same"), F.count(F.lit(1)).alias("_n"), F.min("key").alias("_one"))
    return found.select("repo", "name", F.when(F.col("_same"), F.col("name")).when(F.col("_n") == 1, F.col("_one")).alias("key")).filter("key is not null")


def mounted(facts: DataFrame) -> DataFrame:
    """(repo, owner, prefix): the prefixes under which a router, by any name it goes by, is reachable."""
    routers = facts.filter("fact = 'router'").groupBy("repo", F.col("owner").alias("name")).agg(F.max("path").alias("own"), F.bool_or(F.col("extra") == "flask").alias("flask"))
    mounts, aliases = facts.filter("fact = 'mount'"), facts.filter("fact = 'alias'").select("repo", F.col("owner").alias("name"), "target").distinct()
    every = facts.filter("fact in ('route', 'skipped', 'mount')").select("repo", F.col("owner").alias("name"))
    references = every.unionByName(mounts.select("repo", F.col("target").alias("name"))).unionByName(aliases.select("repo", F.col("target").alias("name"))).filter("name <> ''")
    places = _known_places(references, routers.select("repo", "name").unionByName(aliases.select("repo", "name")))
    # Names that packages pass on are followed to the module that declares the router.
    step = aliases.join(places.select("repo", F.col("name").alias("target"), "key"), ["repo", "target"]).filter("key <> name")
    chased = resolve_aliases(step.groupBy(_key("repo", "name").alias("name")).agg(F.min(_key("repo", "key")).alias("target")))
    staging = Staging(facts.sparkSession, "mounted")
    named = references.distinct().join(places, ["repo", "name"], "left").withColumn("key", _key("repo", F.coalesce("key", "name")))
    resolved = staging.save(named.join(chased.select(F.col("name").alias("key"), "declared"), "key", "left").select("repo", "name", F.coalesce("declared", "key").alias("key")), "resolved")
    child, parent = (resolved.select("repo", F.col("name").alias(c), F.col("key").alias(f"{c}_key")) for c in ("target", "owner"))
    edges = mounts.join(child, ["repo", "target"]).join(parent, ["repo", "owner"]).select(F.col("owner_key").alias("parent"), F.col("target_key").alias("child"), F.coalesce("path", F.lit("")).alias("prefix"))
    known = routers.select(_key("repo", "name").alias("key"), "own", "flask")
    edges = edges.filter("parent <> child").distinct().join(known.select(F.col("key").alias("child"), "flask"), "child", "left").select(
        "parent", "child", "prefix", F.lit("").alias("version"), (F.coalesce("flask", F.lit(False)) & (F.col("prefix") != "")).alias("replaces"))
    ends = edges.select(F.col("parent").alias("key")).union(edges.select("child")).distinct().join(known, "key", "left_anti").select("key", F.lit("").alias("own"))
    prefixes = compose_prefixes(known.select("key", "own").unionByName(ends), edges)
    return resolved.join(prefixes, "key").select("repo", F.col("name").alias("owner"), "prefix").distinct()


def _flat(facts: DataFrame) -> DataFrame:
    routes = facts.filter("fact = 'route'").join(mounted(facts), ["repo", "owner"], "left")
    kind = F.when(F.col("framework").isin("express", "rails"), F.col("framework")).otherwise("web")
    path = F.when(kind == "web", join_path(reversion(F.coalesce("prefix", F.lit("")), F.col("target")), "path")).otherwise(F.col("path"))
    web = routes.select(F.col("repo").alias("slug"), F.lit("rest").alias("type"), "method", path.alias("path"), F.coalesce("name", F.lit("")).alias("handler"), "framework", "file", "line", F.col("extra").alias("summary"), kind.alias("kind"))
    events = facts.filter("fact = 'event'").select(F.col("repo").alias("slug"), F.lit("event").alias("type"), "method", "path", F.lit("").alias("handler"), "framework", "file", "line", F.lit(None).cast("string").alias("summary"), F.lit("messaging").alias("kind"), "extra")
    place = F.concat_ws(":", "file", F.coalesce(F.col("line").cast("string"), F.col("extra")))
    rows = web.withColumn("extra", F.lit(None).cast("string")).unionByName(events)
    order = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "file", F.coalesce("line", F.lit(0)), F.coalesce("extra", F.lit("")), "handler")
    return rows.withColumns({"place": place, "order": order}).drop("extra")


def interfaces(facts: DataFrame) -> DataFrame:
    """slug, type, method, path, handler, framework, summary, evidence, id: one row per (slug, method, path).

    The first reader in order of precedence owns a path; what the same reader says again adds its place to the
    evidence, another reader's word is silent. A Rails route also points at its controller action.
    """
    staging = Staging(facts.sparkSession, "interfaces")  # facts are parsed once, they and the routes are read several times below
    facts = staging.save(facts, "facts")
    flat = staging.save(_flat(facts), "flat")
    key = ["slug", "method", "path"]
    first = flat.groupBy(*key).agg(F.min_by(F.struct("type", "handler", "framework", "summary", "kind"), "order").alias("m"))
    own = flat.join(first.select(*key, F.col("m.kind").alias("kind")), [*key, "kind"]).groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("order", "place"))).alias("e"))
    merged = first.join(own, key).select(*key, "m.type", "m.handler", "m.framework", "m.summary", F.array_distinct(F.transform("e", lambda x: x["place"])).alias("evidence"))
    actions = facts.filter("fact = 'action'").groupBy(F.col("repo").alias("slug"), F.col("name").alias("handler")).agg(
        F.min_by(F.concat_ws(":", "file", "line"), F.struct(F.col("extra") != "full", "file", "line")).alias("_action"))
    merged = merged.join(actions, ["slug", "handler"], "left").withColumn("evidence", F.when(F.col("_action").isNotNull(), F.array_distinct(F.array_append("evidence", F.col("_action")))).otherwise(F.col("evidence")))
    base = merged.withColumn("base", F.concat(F.lit("interface:"), F.col("slug"), F.lit(":"), F.lower("method"), F.lit("-"), path_slug("path")))
    named = unique_ids(base, "base", [F.col("path"), F.col("method")])
    return named.select("slug", "type", "method", "path", "handler", "framework", "summary", "evidence", F.col("uid").alias("id"))


def duplicate_paths(facts: DataFrame) -> DataFrame:
    """Dead letters: routes of one reader that land on a path another of its routes has (slug, file, line, reason, method, expr, snippet)."""
    staging = Staging(facts.sparkSession, "duplicates")
    flat = staging.save(_flat(staging.save(facts, "facts")), "flat")
    key = ["slug", "method", "path"]
    first = flat.groupBy(*key).agg(F.min(F.struct("order", "kind", "place")).alias("m"))
    again = flat.join(first, key).filter((F.col("kind") == F.col("m.kind")) & (F.col("order") > F.col("m.order")))
    return again.select("slug", "file", "line", F.lit("duplicate-path").alias("reason"), "method", F.col("path").alias("expr"), F.concat(F.lit("also declared at "), F.col("m.place")).alias("snippet"))
