"""Links between services: resolved out of what a catalog holds, all of them or only those a change reaches.

Every link is an aggregate over facts of the service it starts at, joined with facts of others. So a change is
followed by the joins themselves: they are run with the changed rows on one side, and the services on the other
side that meet one are those whose links may differ. Only these are resolved again; the rest keep their rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import FACTORS, Catalog, stubs
from .operators import resolve, rules
from .operators.lookup import without_stubs
from .schema import EDGES, PAYLOADS
from .sources.staging import Staging

#: What links are called by their makers.
LINKERS = ("resolver", "guidance")
#: What the facts of links are read from.
FACTS = ("service", "interface", "guidance")
#: The kinds of links that are resolved apart, and the relationships that they make.
KINDS = {"calls": ("calls",), "channels": ("publishes_to", "shares_channel"), "rules": ("governed_by",)}
#: Call edges up to which each is written; beyond, they are kept as groups of callers and members.
MAX_SINGLE = 100_000


def edge_rows(rows: DataFrame, relationship: str, source: str) -> DataFrame:
    """Rows with from_id and to_id, and whatever else of an edge they have."""
    kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in EDGES.split(", ")}
    fixed = {"relationship": F.lit(relationship), "source": F.lit(source)}
    return rows.select(*(fixed[c].alias(c) if c in fixed else F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def _id(slug: str) -> Column:
    return F.concat(F.lit("service:"), slug)


def _parsed(objects: DataFrame, kind: str) -> DataFrame:
    """id, slug and the fields of the payload, in no order."""
    rows = without_stubs(objects).filter(F.col("object_type") == kind)
    return rows.select("id", "slug", F.from_json("payload", PAYLOADS[kind]).alias("_p")).select("id", "slug", "_p.*")


def facts(objects: DataFrame, staging: Staging, name: str) -> dict[str, DataFrame]:
    """services, interfaces, calls, bindings, declared, ends and rules of the objects; payloads are parsed once."""
    held = _parsed(objects, "service").select(
        "id", "slug", F.coalesce("identity.port", F.lit("")).alias("port"), F.coalesce("identity.name", F.lit("")).alias("alias"), "outbound", "host_bindings", "declared_hosts", "dependencies", "languages", "language")
    held = staging.save(held, f"{name}-services")
    interfaces = staging.save(_parsed(objects, "interface").select("slug", "type", "method", "path", "framework"), f"{name}-interfaces")
    written = _parsed(objects, "guidance").select("id", "status", F.col("applies_to.dependencies").alias("dependencies"), F.col("applies_to.languages").alias("languages"))
    return {
        "services": held.select("id", "slug", "port", F.col("alias").alias("name"), "dependencies", "languages", "language"), "interfaces": interfaces,
        "calls": held.select("slug", F.posexplode("outbound").alias("pos", "c")).select("slug", "pos", "c.verb", "c.path", "c.host"),
        "bindings": held.select("slug", F.explode("host_bindings").alias("b")).select("slug", "b.key", "b.value", "b.host", "b.port"),
        "declared": held.select("slug", F.posexplode(F.map_entries("declared_hosts")).alias("pos", "h")).select("slug", "pos", F.col("h.key").alias("pattern"), F.col("h.value").alias("target")),
        "ends": resolve.channel_ends(interfaces), "rules": staging.save(written, f"{name}-rules"),
    }


def _call_links(outbound: DataFrame, known: dict[str, DataFrame], declared: DataFrame, staging: Staging) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Call edges (from_slug, to_slug, ...) that stand by themselves, and groups and members for the rest if they are many.

    Beside groups those stand by themselves of which a host or the configuration says something; the groups leave them out.
    """
    groups, classes = resolve.call_groups(outbound, known["interfaces"], known["services"])
    sizes = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("pairs"))
    if (groups.join(sizes, "cls").agg(F.sum("pairs")).first()[0] or 0) <= MAX_SINGLE:
        return resolve.merge_declared(resolve.group_edges(groups, classes), declared), None
    declared = staging.save(declared, "declared")
    apart = staging.save(resolve.edges_apart(groups, classes, declared), "apart")
    lists = apart.groupBy(F.col("from_slug").alias("slug"), "cls").agg(F.collect_list(_id("to_slug")).alias("apart"))
    made = F.concat(F.lit(staging.root.rsplit("-", 1)[-1] + ":"), F.substring("cls", 1, 32)).alias("cls")  # classes of other linkings may stand beside
    rows = groups.join(lists, ["slug", "cls"], "left").join(sizes, "cls").select(
        _id("slug").alias("from_id"), F.lit("calls").alias("relationship"), F.lit("resolver").alias("source"), F.col("first").alias("confidence"), "via_paths", "apart", made, "pairs")
    members = classes.join(groups.select("cls").distinct(), "cls", "left_semi").select(made, _id("provider").alias("to_id"))
    return resolve.merge_declared(apart.drop("cls"), declared), (staging.save(rows, "groups"), staging.save(members, "members"))


def links(known: dict[str, DataFrame], staging: Staging, sources: DataFrame | None = None, kinds: tuple[str, ...] = tuple(KINDS)) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """The edges of some kinds out of the facts, or those of them that start at the given services (``slug``, ``kind``).

    Many call edges come as groups and members (``FACTORS``) beside the others.
    """
    def of(table: str, kind: str, keep: Column | None = None) -> DataFrame:
        """The facts of the services in question, and those rows that ``keep`` names whosesoever they are."""
        if sources is None:
            return known[table]
        mine = sources.filter(F.col("kind") == kind).select("slug")
        held = known[table].join(mine, "slug", "left_semi").select(*known[table].columns)
        return held if keep is None else known[table].filter(keep).unionByName(held.filter(~keep))

    ended = lambda rows: rows.withColumns({"from_id": _id("from_slug"), "to_id": _id("to_slug")})
    new = edge_rows(known["services"].limit(0).select(F.col("id").alias("from_id"), F.col("id").alias("to_id")), "calls", "resolver")
    factors = None
    if "calls" in kinds:
        declared = resolve.declared_edges(resolve.resolve_hosts(of("bindings", "calls"), known["services"], of("declared", "calls")))
        called, factors = _call_links(of("calls", "calls"), known, declared, staging)
        new = new.unionByName(edge_rows(ended(called), "calls", "resolver"))
    if "channels" in kinds:
        published = resolve.publish_edges(of("ends", "channels", F.coalesce(F.col("direction") != "PUBLISH", F.lit(True))))
        shared = resolve.shared_edges(known["ends"], None if sources is None else sources.filter("kind = 'channels'"))
        new = new.unionByName(edge_rows(ended(published), "publishes_to", "resolver")).unionByName(edge_rows(ended(shared), "shares_channel", "resolver"))
    if "rules" in kinds:
        governed = rules.governed_by(known["rules"], rules.matchable(of("services", "rules"))).join(known["rules"].select(F.col("id").alias("rule"), "status"), "rule")
        new = new.unionByName(edge_rows(governed.select(F.col("service").alias("from_id"), F.col("rule").alias("to_id"), "matched", "status"), "governed_by", "guidance"))
    return staging.save(new, "links"), factors


def _differing(old: DataFrame, new: DataFrame, keys: list[str], content: list) -> DataFrame:
    """Keys whose rows differ in number or content: signed sums of hashes, combined before the exchange."""
    one = lambda rows, sign: rows.select(*keys, F.lit(sign).alias("_n"), (F.xxhash64(*content).cast("decimal(20,0)") * sign).alias("_h"))
    sums = one(old, -1).unionByName(one(new, 1)).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"))
    return sums.filter("_n <> 0 or _h <> 0").select(*keys)


def _changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows that only one side has."""
    a, b = old.distinct().withColumn("_side", F.lit(1)), new.distinct().withColumn("_side", F.lit(2))
    return a.unionByName(b).groupBy(*old.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def _kind() -> Column:
    kind = F.lit("calls")
    for name, made in KINDS.items():
        kind = F.when(F.col("relationship").isin(*made), name).otherwise(kind)
    return kind


def affected(before: dict[str, DataFrame], after: dict[str, DataFrame], known: dict[str, DataFrame], staging: Staging) -> DataFrame:
    """(slug, kind) of the services whose links of a kind may differ.

    ``before`` and ``after`` are the facts of the objects that differ, as they were and as they are; ``known``
    all facts as they are. Beside the services that changed themselves these are reached:

    * by a changed interface: callers of a shape that it offers, as their number of providers differs;
    * by a service that came or went: callers of a host in which its name occurs, external or not by that;
    * by a service with another name or port: the bindings that it would be the target of if it stood alone,
      as it may win or lose a rule only where it is hit by one;
    * by a changed end: all ends of its channel, which may be published or not by that;
    * by a changed rule: the services that the rule, as it was or is, governs.
    """
    def changed(table: str, *columns: str) -> DataFrame | None:
        """Written, so that what no row changed costs no join."""
        rows = staging.save(_changed_rows(before[table].select(*columns), after[table].select(*columns)), "changed-" + "-".join((table, *columns)))
        return None if rows.isEmpty() else rows

    own = before["services"].select("slug").unionByName(after["services"].select("slug"))
    parts = [("calls", own), ("rules", own)]
    if (offers := changed("interfaces", "slug", "type", "method", "path")) is not None:
        parts.append(("calls", resolve.callers_of(known["calls"], offers)))
    if (named := changed("services", "slug", "port", "name")) is not None:
        parts.append(("calls", resolve.resolve_hosts(known["bindings"], named, known["declared"].limit(0)).select("slug")))
        hosts = resolve.hosts_naming(known["calls"].select("host").filter("host <> ''").distinct(), _changed_rows(before["services"].select("slug"), after["services"].select("slug")))
        parts.append(("calls", known["calls"].join(hosts, "host", "left_semi").select("slug")))
    if (ends := changed("ends", "slug", "channel", "direction", "framework")) is not None:
        parts += [("channels", ends.select("slug")), ("channels", known["ends"].join(ends.select("channel").distinct(), "channel", "left_semi").select("slug"))]
    if (written := changed("rules", "id", "status", "dependencies", "languages")) is not None:
        parts.append(("rules", rules.governed_by(written, rules.matchable(known["services"])).select(F.substring_index("service", ":", -1).alias("slug"))))
    rows = own.limit(0).select("slug", F.lit("calls").alias("kind"))
    for kind, part in parts:
        rows = rows.unionByName(part.select("slug", F.lit(kind).alias("kind")))
    return rows.distinct()


def _commit(catalog: Catalog, staging: Staging, objects: DataFrame, kept: DataFrame, new: DataFrame, place: str | None, old: tuple | None = None, factors: tuple | None = None) -> None:
    """Kept and new edges and groups, with a placeholder for each end that is no object; objects are written only if there is one."""
    ends = [new.select(F.col("from_id").alias("id")), new.select(F.col("to_id").alias("id"))]
    tables = {"edges": kept.select(*new.columns).unionByName(new)}  # both lie in tables: not written once more before the commit
    if factors is not None:
        ends += [factors[0].select(F.col("from_id").alias("id")), factors[1].select(F.col("to_id").alias("id"))]
    for name, *parts in zip(FACTORS, old or (None, None), factors or (None, None), strict=True):
        if held := [p for p in parts if p is not None]:
            tables[name] = held[0] if len(held) == 1 else held[0].unionByName(held[1])
    ghosts = staging.save(stubs(reduce(DataFrame.unionByName, ends), objects), "stubs")
    if not ghosts.isEmpty():
        tables["objects"] = staging.save(objects.unionByName(ghosts.select(*objects.columns)), "objects")
    catalog.commit(linked=place, **tables)


def relink(catalog: Catalog) -> None:
    """Resolve the calls, bindings and channels of all services again and match them with the rules, out of what the catalog holds."""
    objects, (edges, _), place = catalog.table("objects"), catalog.edge_parts(), catalog.place("objects")
    staging = Staging(catalog.spark, "relink")
    new, factors = links(facts(objects, staging, "all"), staging)
    _commit(catalog, staging, objects, edges.filter(~F.col("source").isin(*LINKERS)), new, place, None, factors)


def _kept_factors(factors: tuple[DataFrame, DataFrame] | None, reached: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame] | None:
    """Groups whose callers are not reached, with the members of their classes; None if there are none."""
    if factors is None:
        return None
    groups = staging.save(factors[0].join(reached.filter("kind = 'calls'"), "from_id", "left_anti").select(*factors[0].columns), "kept-groups")
    if groups.isEmpty():
        return None
    return groups, staging.save(factors[1].join(groups.select("cls").distinct(), "cls", "left_semi").select(*factors[1].columns), "kept-members")


def relink_changed(catalog: Catalog) -> int:
    """Bring the links up to date with what changed since they were made; the number of (service, kind) resolved again.

    The result is that of ``relink``. Changes are found, not told: objects whose content differs from what was
    linked last, and services some of whose links were removed or altered since. A catalog that never was linked
    is linked whole.
    """
    held, place = catalog.linked(), catalog.place("objects")
    if held is None:
        relink(catalog)
        return -1
    objects, edges = catalog.table("objects"), catalog.table("edges")
    same_edges = catalog.place("edges") == catalog.place("linked_edges")
    if place == catalog.place("linked_objects") and same_edges:
        return 0
    staging = Staging(catalog.spark, "relink")
    of = lambda rows: rows.filter(F.col("object_type").isin(*FACTS))  # noqa: E731  by folder: symbols are not read
    diff = staging.save(_differing(of(held["objects"]), of(objects), ["id"], ["object_type", "slug", "source", "payload"]), "diff")
    some = lambda rows: of(rows).join(diff, "id", "left_semi").select(*rows.columns)
    known = facts(objects, staging, "all")
    reached = affected(facts(some(held["objects"]), staging, "old"), facts(some(objects), staging, "new"), known, staging).select(_id("slug").alias("from_id"), "kind")
    if not same_edges:
        made = lambda rows: rows.filter(F.col("source").isin(*LINKERS)).withColumn("kind", _kind())
        reached = reached.unionByName(_differing(made(held["edges"]), made(edges), ["from_id", "kind"], [F.to_json(F.struct(*(c for c in edges.columns)))]))
    reached = staging.save(reached.distinct(), "reached")
    counts = {r["kind"]: r["count"] for r in reached.groupBy("kind").count().collect()}  # a row per kind
    if not counts:
        catalog.commit(linked=place)
        return 0
    sources = reached.filter(F.startswith("from_id", F.lit("service:"))).select(F.expr("substring(from_id, 9)").alias("slug"), "kind")
    new, factors = links(known, staging, sources, tuple(counts))
    single, old = catalog.edge_parts()
    tagged = single.withColumn("kind", F.when(F.col("source").isin(*LINKERS), _kind()))
    kept = staging.save(tagged.join(reached, ["from_id", "kind"], "left_anti").select(*edges.columns), "kept")
    _commit(catalog, staging, objects, kept, new, place, _kept_factors(old, reached, staging), factors)
    return sum(counts.values())
