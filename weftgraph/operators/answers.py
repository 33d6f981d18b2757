"""The query surface: one function per question, each with a status and its tables.

``status`` is ``ok``, ``not_found`` (with near ids), ``unavailable``, ``unknown``, ``no_match`` or
``span_mismatch``. Tables stay DataFrames; ``Answer.collected`` brings a bounded part of them to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_sentence
from ..schema import PAYLOADS
from . import graph, lookup, rules, semantic
from .source import get_source

Embed = Callable[[list[str]], list[list[float]]]
SYMBOL_FORM, INTERFACE_FORM, SERVICE_FORM = "code_symbol:<slug>:<path>::<qualname>", "interface:<slug>:<id>", "service:<slug>"
#: Rules given for a topic.
TOPIC_RULES = 3


@dataclass
class Answer:
    status: str
    about: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def collected(self, limit: int = 1000) -> dict:
        """Everything as plain values, at most ``limit`` rows a table."""
        return {"status": self.status, **self.about} | {k: [r.asDict(recursive=True) for r in t.limit(limit).collect()] for k, t in self.tables.items()}


def payload(objects: DataFrame, kind: str) -> DataFrame:
    """Objects of one kind with the fields of their payload beside them."""
    rows = lookup.list_objects(objects, kind)
    return rows.withColumn("_p", F.from_json("payload", PAYLOADS[kind])).select(*objects.columns, "_p.*") if kind in PAYLOADS else rows


def service_counts(objects: DataFrame) -> DataFrame:
    """slug, interfaces, symbols: counted from the objects themselves."""
    rows = lookup.without_stubs(objects).filter(F.col("object_type").isin("interface", "code_symbol"))
    return rows.groupBy("slug").agg(F.count_if(F.col("object_type") == "interface").alias("interfaces"), F.count_if(F.col("object_type") == "code_symbol").alias("symbols"))


def list_services(objects: DataFrame) -> Answer:
    """Every service with its interfaces and symbols counted."""
    services = lookup.list_objects(objects, "service").select("id", "name", "slug")
    rows = services.join(service_counts(objects), "slug", "left").select("id", "name", F.coalesce("interfaces", F.lit(0)).alias("interfaces"), F.coalesce("symbols", F.lit(0)).alias("symbols"))
    return Answer("ok", {}, {"services": rows.orderBy("id")})


def get_index_info(objects: DataFrame, edges: DataFrame) -> Answer:
    return Answer("ok", {}, {"info": lookup.index_info(objects, edges), "by_type": lookup.by_type(objects)})


def edge_cards(edges: DataFrame) -> DataFrame:
    """from, to, weight; an edge without a weight counts once."""
    weight = F.coalesce("weight", F.lit(1)) if "weight" in edges.columns else F.lit(1)
    return edges.select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), weight.alias("weight"))


def get_service_graph(objects: DataFrame, edges: DataFrame, min_confidence: str = "") -> Answer:
    """The whole mesh: services with counts and degrees, edges, groups that look like one code base deployed twice."""
    mesh = graph.mesh_edges(edges, min_confidence, ("via_paths", "channels", "via_hosts", "via_config_keys"))
    services = lookup.list_objects(objects, "service").select("id", "name", "slug").join(service_counts(objects), "slug", "left").select(
        "id", "name", F.coalesce("symbols", F.lit(0)).alias("symbol_count"), F.coalesce("interfaces", F.lit(0)).alias("interface_count"))
    return Answer("ok", {}, {
        "services": graph.mesh_services(services, mesh).orderBy("id"), "edges": mesh.orderBy("from_id", "to_id", "relationship"),
        "likely_duplicate_deployments": graph.likely_duplicates(services)})


def _is_there(objects: DataFrame, id: str) -> bool:
    return not objects.filter(F.col("id") == id).limit(1).isEmpty()


def get(objects: DataFrame, id: str) -> DataFrame:
    """One object by id: a row or none."""
    return objects.filter(F.col("id") == id).limit(1)


def not_found(objects: DataFrame, given: str, form: str) -> Answer:
    """Says how an id looks and which ids are near."""
    return Answer("not_found", {"id": given, "expected_format": form}, {"did_you_mean": lookup.suggest(objects, given, form.split(":")[0]).select("id")})


def list_interfaces(objects: DataFrame, service: str) -> Answer:
    if not _is_there(objects, service):
        return not_found(objects, service, SERVICE_FORM)
    return Answer("ok", {"service": service}, {"interfaces": lookup.list_interfaces(payload(objects, "interface"), service.split(":", 1)[1])})


def get_service_relationships(objects: DataFrame, edges: DataFrame, service: str) -> Answer:
    if not _is_there(objects, service):
        return not_found(objects, service, SERVICE_FORM)
    return Answer("ok", {"service": service}, {"related": graph.one_hop(edges, objects.select("id", "name"), service).orderBy("side", "relationship", "id")})


def _symbols(objects: DataFrame) -> DataFrame:
    return payload(objects, "code_symbol").select("id", "name", "qualname", "path", "kind", "line_start")


def _neighbors(objects: DataFrame, edges: DataFrame, symbol: str, direction: str, max_depth) -> Answer:
    if not _is_there(objects, symbol):
        return not_found(objects, symbol, SYMBOL_FORM)
    depth = lookup.clamp(max_depth, 2, 1, 6)
    found, nodes, cut = graph.neighbors(edges, _symbols(objects), symbol, direction, depth)
    cards = found.join(edges.filter("relationship = 'calls'"), ["from_id", "to_id"])
    return Answer("ok", {"root": symbol, "direction": "callees" if direction == "out" else "callers", "max_depth": depth, "truncated": cut}, {"nodes": nodes.orderBy("id"), "edges": edge_cards(cards).orderBy("from", "to")})


def get_callees(objects: DataFrame, edges: DataFrame, symbol: str, max_depth=2) -> Answer:
    return _neighbors(objects, edges, symbol, "out", max_depth)


def get_callers(objects: DataFrame, edges: DataFrame, symbol: str, max_depth=2) -> Answer:
    return _neighbors(objects, edges, symbol, "in", max_depth)


def get_endpoint_call_graph(objects: DataFrame, edges: DataFrame, interface: str, max_depth=3) -> Answer:
    """Handlers of an endpoint and what they reach; without a handler nothing, and a note."""
    if not _is_there(objects, interface):
        return not_found(objects, interface, INTERFACE_FORM)
    handlers = edges.filter((F.col("relationship") == "handled_by") & (F.col("from_id") == interface)).select(F.col("to_id").alias("id")).distinct()
    if handlers.isEmpty():
        return Answer("ok", {"interface": interface, "note": "no handler resolved: the framework provides it, or its evidence names no code", "truncated": False}, {"handlers": handlers})
    depth = lookup.clamp(max_depth, 3, 1, 6)
    found, nodes, cut = graph.endpoint_trace(edges, interface, depth)
    cards = found.join(edges.filter("relationship = 'calls'"), ["from_id", "to_id"])
    return Answer("ok", {"interface": interface, "max_depth": depth, "truncated": cut}, {"handlers": handlers.orderBy("id"), "nodes": graph.hydrate(nodes, _symbols(objects)).orderBy("id"), "edges": edge_cards(cards).orderBy("from", "to")})


def get_symbol(objects: DataFrame, edges: DataFrame, symbol: str) -> Answer:
    """A symbol with its direct callers and callees counted, edge by edge."""
    if not _is_there(objects, symbol):
        return not_found(objects, symbol, SYMBOL_FORM)
    calls = edges.filter("relationship = 'calls'").agg(F.count_if(F.col("from_id") == symbol).alias("direct_callees"), F.count_if(F.col("to_id") == symbol).alias("direct_callers"))
    return Answer("ok", {"id": symbol}, {"symbol": get(objects, symbol).select("id", "name", "payload").crossJoin(F.broadcast(calls))})  # a row times a row


def find_symbol(objects: DataFrame, query: str, limit=20) -> Answer:
    return Answer("ok", {"query": query}, {"symbols": lookup.find_tiered(objects, query, "code_symbol", lookup.clamp(limit, 20, 1, 100))})


def discover(objects: DataFrame, vectors: DataFrame, query: str, object_type: str, model: str, embed: Embed | None, limit=5) -> Answer:
    """Nearest objects of a type by meaning; ``unavailable`` without an embedder."""
    if embed is None:
        return Answer("unavailable", {"reason": "no embedding model is configured"})
    hits = semantic.discover(vectors, objects, embed([query])[0], object_type, model, lookup.clamp(limit, 5, 1, 25))
    return Answer("ok", {"query": query}, {"results": hits})


# Written rules.

def rule_card(text: Column, full: Column | bool) -> Column:
    """id, title, status, scope, reviewed, owner, and the text of a rule, whole or its first sentence."""
    return F.struct("id", F.col("name").alias("title"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("scope", F.lit("")).alias("scope"),
                    F.coalesce(F.col("reviewed").cast("string"), F.lit("never reviewed")).alias("reviewed"), "owner", F.when(F.lit(full) if isinstance(full, bool) else full, text).otherwise(first_sentence(text)).alias("guidance"))


def _cards(rows: DataFrame, full: bool, *more: str) -> DataFrame:
    return rows.select(rule_card(F.col("summary"), full).alias("_c"), *more).select("_c.*", *more)


def get_engineering_guidance(objects: DataFrame, links: DataFrame, services: DataFrame, vectors: DataFrame | None = None, topic: str = "", service: str = "", detail: str = "auto",
                             model: str = "", embed: Embed | None = None, min_score: float = 0.0) -> Answer:
    """Rules of a service in full, the nearest few to a topic, or all of them as titles.

    links(service, rule, matched), services(id, dependencies[], languages[], language). A topic that is a
    rule's id gives that rule. A floor on scores is off by default; without an embedder a topic lists all.
    """
    every = payload(objects, "guidance")
    if service:
        id = f"service:{service.split(':', 1)[-1]}"
        known = services.filter(F.col("id") == id)
        if known.isEmpty():
            return Answer("not_found", {"service": id})
        if rules.matchable(known).isEmpty():
            return Answer("unknown", {"service": id, "reason": "no dependencies or languages are recorded for it, so no rule can be matched"})
        held = links.filter(F.col("service") == id).select(F.col("rule").alias("id"), "matched")
        because = F.when(F.size("matched") > 0, F.array_join("matched", ", ")).otherwise("applies to every service")
        rows = _cards(every.join(held, "id").withColumn("because", because), detail != "titles", "because")
        return Answer("ok", {"service": id}, {"rules": rules.rank_rules(rows)})
    if topic:
        exact = every.filter(F.col("id") == f"guidance:{topic}")
        if not exact.isEmpty():
            return Answer("ok", {"topic": topic}, {"rules": _cards(exact, detail != "titles")})
        if embed is None or vectors is None:
            return Answer("ok", {"topic": topic, "note": "no embedding model: all rules are listed"}, {"rules": rules.rank_rules(_cards(every, False))})
        hits = search_topic(vectors, embed([topic])[0], model, min_score)
        if hits.isEmpty():
            return Answer("no_match", {"topic": topic})
        return Answer("ok", {"topic": topic}, {"rules": _cards(every.join(F.broadcast(hits), "id"), detail == "full", "score").orderBy(F.desc("score"), "id")})
    return Answer("ok", {}, {"rules": rules.rank_rules(_cards(every, detail == "full"))})


def search_topic(vectors: DataFrame, query: list[float], model: str, min_score: float = 0.0, limit: int = TOPIC_RULES) -> DataFrame:
    """id, score of the nearest rules; with a floor only those that reach it."""
    rows = vectors.filter((F.col("object_type") == "guidance") & (F.col("model") == model))
    hits = semantic.top_k(rows, query, limit, "object_id")
    return hits.filter(F.col("score") >= min_score) if min_score else hits


def source_of(objects: DataFrame, texts: DataFrame, symbol: str, context_lines=0, max_lines=200) -> Answer:
    """Source of one symbol; refused if no text with the recorded hash is at hand."""
    if not _is_there(objects, symbol):
        return not_found(objects, symbol, SYMBOL_FORM)
    rows = payload(get(objects, symbol), "code_symbol").select("id", "path", "line_start", "line_end", "file_sha")
    found = get_source(rows, texts, lookup.clamp(context_lines, 0, 0, 50), lookup.clamp(max_lines, 200, 1, 500))
    said = found.select("status").first()
    return Answer(said["status"] if said else "unavailable", {"id": symbol}, {"source": found})


# Lookups among enrichments.

def enrichment_hashes(enrichments: DataFrame, object_type: str, model: str) -> DataFrame:
    """id, content_hash of what is stored for one type and model."""
    return enrichments.filter((F.col("object_type") == object_type) & (F.col("model") == model)).select(F.col("object_id").alias("id"), "content_hash")


def any_summary(enrichments: DataFrame) -> DataFrame:
    """id, summary: that of the first model by name that has one."""
    said = enrichments.filter(F.coalesce("summary", F.lit("")) != "")
    return said.groupBy(F.col("object_id").alias("id")).agg(F.min_by("summary", F.struct("model", "summary")).alias("summary"))


def owned_by(objects: DataFrame, slug: str) -> DataFrame:
    """Objects of one service or library."""
    own = F.when(F.col("object_type").isin("service", "library"), F.element_at(F.split("id", ":", 2), -1)).otherwise(F.element_at(F.split("id", ":"), 2))
    return objects.filter(own == slug)
