"""Bounded traversal and the service mesh over edges(from_id, relationship, to_id, source, confidence, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CONFIDENCE, join_path, ranked, reversion
from ..sources.staging import Staging
from .adjacency import Adjacency


#: Visited ids that are broadcast to find their edges.
MAX_BROADCAST = 20_000


def frontier_edges(edges: DataFrame, frontier: DataFrame, direction: str = "out", relationship: str | None = None) -> DataFrame:
    """Edges that touch the frontier (``id``), in one scan for the whole level."""
    if relationship is not None:
        edges = edges.filter(F.col("relationship") == relationship)
    out = edges.join(frontier.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(*edges.columns)
    into = edges.join(frontier.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*edges.columns)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into).distinct()


def edges_of(edges: DataFrame, id: str, direction: str = "both") -> DataFrame:
    out, into = F.col("from_id") == id, F.col("to_id") == id
    return edges.filter(out if direction == "out" else into if direction == "in" else out | into)


def walk(edges: DataFrame | Adjacency, seeds: DataFrame, direction: str = "out", max_depth: int = 2, max_nodes: int = 300, relationship: str = "calls") -> tuple[DataFrame, DataFrame, bool]:
    """Edges seen, nodes reached (``id``, ``depth``; seeds excluded) and whether the cap cut the walk.

    Each level is one join of the frontier with the edges, of which only those found are made distinct. Every edge at a visited node is returned, back
    edges included. Nodes are admitted in (from, to) order of their first edge up to ``max_nodes`` visited,
    seeds counted. Levels are written tables, earlier ones are not written again; the driver holds counts only.
    ``edges`` kept as an ``Adjacency`` are not exchanged by any level; ``relationship`` is that of its making then.
    """
    staging = Staging(edges.sparkSession, "walk")
    near, far = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    if isinstance(edges, Adjacency):
        touching = lambda frontier, n: edges.touching(frontier, near, n)
    else:
        usable = edges.filter(F.col("relationship") == relationship).select("from_id", "to_id")
        touching = lambda frontier, n: _met(usable, frontier, near, "left_semi", n).distinct()
    reached = [staging.save(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "reached-0")]
    n, truncated, seen = reached[0].count(), False, []
    for depth in range(1, max_depth + 1):
        visited = reached[0]
        for more in reached[1:]:
            visited = visited.unionByName(more)
        # Two writes a level, the frontier's edges with whether their far end is known, and the nodes that are new.
        frontier, held = reached[-1].select(F.col("id").alias(near)), visited.select(F.col("id").alias(far), F.lit(True).alias("_held"))
        level = staging.save(_met(touching(frontier, n), held, far, "left", n), f"level-{depth}")
        seen.append(level.select("from_id", "to_id"))
        fresh = level.filter("_held is null").groupBy(F.col(far).alias("id")).agg(F.min(F.struct("from_id", "to_id")).alias("_by")).withColumn("depth", F.lit(depth))
        fresh = staging.save(fresh, f"reached-{depth}")
        count, room = fresh.count(), max_nodes - n
        if count > room:  # the cap is the feature: the first nodes by the edge that led to them
            truncated, count = True, room
            fresh = staging.save(fresh.orderBy("_by", "id").limit(room), f"kept-{depth}")
        if not count:
            break
        reached.append(fresh.select("id", "depth"))
        n += count
    found, nodes = seen[0], edges.sparkSession.createDataFrame([], "id string, depth int")
    for level in seen[1:]:
        found = found.unionByName(level)
    for more in reached[1:]:
        nodes = nodes.unionByName(more)
    return found.distinct(), nodes, truncated


def _met(edges: DataFrame, ids: DataFrame, on: str, how: str, n: int) -> DataFrame:
    """Edges joined with visited ids, which are broadcast as far as their number is known to be small."""
    return edges.join(F.broadcast(ids) if n <= MAX_BROADCAST else ids, on, how)


def hydrate(ids: DataFrame, nodes: DataFrame, id: str = "id") -> DataFrame:
    """``ids`` with the nodes' columns; an id without a node keeps its row with nulls."""
    return ids.join(nodes.withColumnRenamed("id", id) if id != "id" else nodes, id, "left")


def neighbors(edges: DataFrame, nodes: DataFrame, id: str, direction: str, depth: int) -> tuple[DataFrame, DataFrame, bool]:
    """Edges and hydrated nodes within ``depth`` (1 to 300) of one symbol."""
    seeds = edges.sparkSession.createDataFrame([(id,)], "id string")
    found, reached, cut = walk(edges, seeds, direction, max(1, min(depth, 300)))
    return found, hydrate(reached, nodes), cut


def endpoint_trace(edges: DataFrame, interface: str, max_depth: int = 3, max_nodes: int = 300) -> tuple[DataFrame, DataFrame, bool]:
    """What an interface reaches: its handlers (depth 0) and what they call."""
    seeds = edges.filter((F.col("relationship") == "handled_by") & (F.col("from_id") == interface)).select(F.col("to_id").alias("id")).distinct()
    found, reached, cut = walk(edges, seeds, "out", max_depth, max_nodes)
    return found, reached.unionByName(seeds.withColumn("depth", F.lit(0))), cut


def degrees(edges: DataFrame, relationship: str | None = None) -> DataFrame:
    """id, n_out, n_in: edge rows, not distinct neighbours; one pass, partial sums before the shuffle."""
    rows = edges if relationship is None else edges.filter(F.col("relationship") == relationship)
    ends = rows.select(F.explode(F.array(
        F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def confidence_floor(label: Column, floor: str) -> Column:
    """Whether a label reaches the floor; an unknown floor passes all, an unknown label always passes."""
    return ranked(label, CONFIDENCE, 99) >= CONFIDENCE.get(floor, -1)


def mesh_edges(edges: DataFrame, min_confidence: str = "", evidence: tuple[str, ...] = ()) -> DataFrame:
    """Service-to-service edges, one per (from, verb, to): the first by source; evidence lists cut to six."""
    inside = F.col("from_id").startswith("service:") & F.col("to_id").startswith("service:") & (F.col("from_id") != F.col("to_id"))
    kept = edges.filter(inside & confidence_floor(F.col("confidence"), min_confidence))
    first = kept.groupBy("from_id", "relationship", "to_id").agg(F.min_by(F.struct("confidence", *evidence), F.struct("source", "confidence")).alias("_e"))
    return first.select("from_id", "relationship", "to_id", "_e.confidence", *(F.slice(f"_e.{c}", 1, 6).alias(c) for c in evidence))


def mesh_services(services: DataFrame, mesh: DataFrame) -> DataFrame:
    """services(id, name, symbol_count, interface_count) with their fan-out and fan-in over the mesh's edges."""
    counts = degrees(mesh)
    return services.join(counts, "id", "left").select(*services.columns, F.coalesce("n_out", F.lit(0)).alias("depends_on_count"), F.coalesce("n_in", F.lit(0)).alias("depended_on_by_count"))


def likely_duplicates(services: DataFrame) -> DataFrame:
    """Groups of services with equal, non-zero counts."""
    return services.filter("symbol_count <> 0 or interface_count <> 0").groupBy("symbol_count", "interface_count").agg(
        F.sort_array(F.collect_list("id")).alias("members")).filter(F.size("members") > 1)


def one_hop(edges: DataFrame, nodes: DataFrame, id: str) -> DataFrame:
    """side (upstream, downstream), relationship, other id and its node; a self-loop is on both sides."""
    down = edges.filter(F.col("from_id") == id).select(F.lit("downstream").alias("side"), "relationship", F.col("to_id").alias("id"))
    up = edges.filter(F.col("to_id") == id).select(F.lit("upstream").alias("side"), "relationship", F.col("from_id").alias("id"))
    return hydrate(down.unionByName(up), nodes)


def dependents(edges: DataFrame, limit: int = 25) -> DataFrame:
    """Per node the services that point to it by any verb, itself excluded, in order."""
    rows = edges.filter(F.col("from_id").startswith("service:") & (F.col("from_id") != F.col("to_id")))
    return rows.groupBy(F.col("to_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("from_id")), 1, limit).alias("dependents"))


def resolve_aliases(aliases: DataFrame, max_hops: int = 24) -> DataFrame:
    """alias(name, target) chains followed to their declaration; cycles and longer chains give null.

    Each round follows what the round before found, so chains of n aliases take log2 n joins; names that have arrived
    enter no further one. The tables are as large as the aliases, so neither side is collected for a broadcast.
    """
    staging = Staging(aliases.sparkSession, "alias")
    most = max_hops + 1
    state = staging.save(aliases.select("name", F.col("target").alias("at"), F.lit(1).alias("hops"), F.lit(True).alias("open")), "alias-0")
    for k in range(1, (most - 1).bit_length() + 2):  # the last round finds that nothing follows
        step = state.select(F.col("name").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.lit(True).alias("open"))
        moved = state.filter("open").drop("open").join(step.hint("merge"), "at", "left").select("name", F.when(F.col("open"), F.col("next")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("open", F.lit(False)).alias("open"))
        state = staging.save(moved.unionByName(state.filter("not open")), f"alias-{k}")
        if state.filter("open").isEmpty():
            break
    return state.select("name", F.when(~F.col("open") & (F.col("hops") <= most), F.col("at")).alias("declared"))


def compose_prefixes(routers: DataFrame, mounts: DataFrame, max_prefixes: int = 8, max_depth: int = 24) -> DataFrame:
    """All prefixes under which each router is reachable: base + edge + own; a replacing edge takes the place of own.

    routers(key, own), mounts(parent, child, prefix, version, replaces). A path that meets itself adds
    nothing. At most ``max_prefixes`` per router, in order.
    """
    staging = Staging(routers.sparkSession, "mounts")
    roots = routers.join(mounts.select(F.col("child").alias("key")).distinct(), "key", "left_anti")
    level = staging.save(roots.select("key", F.col("own").alias("prefix"), F.array("key").alias("path")), "mount-0")
    levels = [level]
    children = mounts.join(routers.withColumnRenamed("key", "child"), "child").withColumnRenamed("prefix", "edge")
    for depth in range(1, max_depth + 1):
        below = level.join(children, level["key"] == children["parent"]).filter(~F.array_contains("path", F.col("child")))
        tail = F.when(F.col("replaces"), F.col("edge")).otherwise(join_path("edge", "own"))
        level = staging.save(below.select(F.col("child").alias("key"), reversion(join_path("prefix", tail), F.col("version")).alias("prefix"), F.concat("path", F.array("child")).alias("path")), f"mount-{depth}")
        if level.isEmpty():
            break
        levels.append(level)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("key").orderBy("prefix")
    return found.select("key", "prefix").distinct().withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_prefixes).drop("_rn")


def layout(nodes: DataFrame, n: int) -> DataFrame:
    """Positions on a circle in id order."""
    at = (F.row_number().over(Window.orderBy("id")) - 1) * (2 * math.pi / max(n, 1))
    return nodes.withColumn("_a", at).select("id", F.round(F.cos("_a"), 6).alias("x"), F.round(F.sin("_a"), 6).alias("y"))
