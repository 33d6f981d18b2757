"""The registered queries of the service-graph operators, each with an independent SQL form for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalar as S
from ..operators import graph, intervals, lookup, quality, resolve, rules, semantic
from .views import duck, load, placed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = "", views: tuple[str, ...] = ()) -> Callable:
    """Register a query under its function's name; views are defined in front of its oracle SQL."""
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        text = sql.strip()
        if text:
            head = duck(*views) if views else ""
            ORACLE[f.__name__] = (f"{head}, {text[5:]}" if text.startswith("with ") else f"{head} {text}") if head else text
        return f
    return add


def joined(c: str) -> F.Column:
    return F.array_join(c, ";").alias(c)


# Resolution.

_CALLS = """
with off as (select slug, path, string_split(path, '/')[2] as a, string_split(path, '/')[3] as b from interfaces),
fresh as (select *, upper(verb) as m, string_split(path, '/') as p, coalesce(host = 'cdn.vendor.example', false) as foreign_host from outbound),
hits as (select f.slug, f.pos, f.path, f.host, off.slug as provider, count(*) over (partition by f.slug, f.pos) as k
  from fresh f join off on f.p[2] = off.a and f.p[3] = off.b where not foreign_host and f.path <> '/')
"""


@query(_CALLS + """
select concat('service:', slug) as from_id, concat('service:', provider) as to_id,
  case when bool_or(coalesce(contains(host, provider), false)) then 'corroborated' when arg_min(k, pos) = 1 then 'high' else 'ambiguous' end as confidence,
  array_to_string(list_sort(list_distinct(list(path)))[1:10], ';') as via_paths
from hits group by slug, provider""", ("interfaces", "outbound"))
def resolve_calls(spark, d):
    edges = resolve.linked_calls(placed(spark, d, "outbound"), load(spark, d, "interfaces"), load(spark, d, "fleet"))
    return edges.select(F.concat(F.lit("service:"), "from_slug").alias("from_id"), F.concat(F.lit("service:"), "to_slug").alias("to_id"), "confidence", joined("via_paths"))


@query(_CALLS + """
select case when foreign_host then 'external' when path = '/' then 'unspecific' when exists (select 1 from hits h where h.slug = f.slug and h.pos = f.pos) then 'resolved' else 'unresolved' end as status,
  count(*) as calls from fresh f group by 1""", ("interfaces", "outbound"))
def resolve_counters(spark, d):
    return resolve.count_calls(load(spark, d, "outbound"), load(spark, d, "interfaces"), load(spark, d, "fleet"))


_ENDS = "with e as (select slug, substr(path, 6) as channel, method, framework from ends)"


@query(_ENDS + """
select p.slug as from_slug, c.slug as to_slug, array_to_string(list_sort(list_distinct(list(p.channel)))[1:20], ';') as channels,
  case when bool_or(p.framework = 'config' or c.framework = 'config') then 'config' else 'static' end as confidence
from e p join e c on p.channel = c.channel and p.method = 'PUBLISH' and c.method in ('CONSUME', 'USES') and p.slug <> c.slug group by 1, 2""", ("ends",))
def resolve_channels(spark, d):
    return resolve.publish_edges(resolve.channel_ends(load(spark, d, "ends"))).select("from_slug", "to_slug", joined("channels"), "confidence")


@query(_ENDS + """
select a.slug as from_slug, b.slug as to_slug, array_to_string(list_sort(list_distinct(list(a.channel)))[1:20], ';') as channels, 'direction-unknown' as confidence
from e a join e b on a.channel = b.channel and a.slug < b.slug where a.channel not in (select channel from e where method = 'PUBLISH') group by 1, 2""", ("ends",))
def resolve_shared(spark, d):
    return resolve.shared_edges(resolve.channel_ends(load(spark, d, "ends"))).select("from_slug", "to_slug", joined("channels"), "confidence")


def _hosts(spark, d) -> DataFrame:
    bound = load(spark, d, "bindings").withColumns({"host": S.bare_host("value"), "port": S.bare_port("value")})
    services = load(spark, d, "services").select("slug", "port", "name")
    declared = spark.createDataFrame([("c1", 0, "s3.*", "nation_1"), ("c4", 0, "s3.amazonaws.com", "nation_4")], "slug string, pos int, pattern string, target string")
    return resolve.resolve_hosts(bound, services, declared)


@query("""
select b.slug, b.key, b.value, case when b.slug = 'c4' then 'nation_4' else t.slug end as target,
  case when b.slug = 'c4' then 'exact' when b.value like '%.svc.%' then 'k8s' when b.value like '%-api:%' then 'slug' when b.value like 'localhost:%' then 'port' else 'key' end as rule
from bindings b left join services t on b.value like concat('http://', t.slug, '.%') or b.value like concat('https://', t.slug, '-api:%') or b.value = concat('localhost:', t.port)
  or b.key = concat('PEERS.', upper(t.slug), '_HOST')
where b.value <> 's3.amazonaws.com' or b.slug = 'c4'""", ("bindings", "services"))
def resolve_declared(spark, d):
    return _hosts(spark, d).select("slug", "key", "value", "target", "rule")


@query("""
with obs as (select concat('c', cast(o_custkey as string)) as f, concat('nation_', cast(count(*) % 25 as string)) as t from orders group by o_custkey),
dec as (select b.slug as f, t.slug as t from bindings b join services t on b.value like concat('http://', t.slug, '.%') or b.value like concat('https://', t.slug, '-api:%')
  or b.value = concat('localhost:', t.port) or b.key = concat('PEERS.', upper(t.slug), '_HOST') union select 'c4', 'nation_4' from customer where c_custkey = 4)
select coalesce(obs.f, dec.f) as from_slug, coalesce(obs.t, dec.t) as to_slug, case when obs.f is null then 'config' when dec.f is null then 'high' else 'corroborated' end as confidence
from obs full outer join dec on obs.f = dec.f and obs.t = dec.t""", ("bindings", "services"))
def merge_declared(spark, d):
    observed = load(spark, d, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("from_slug")).agg(F.concat(F.lit("nation_"), F.count(F.lit(1)) % 25).alias("to_slug"))
    observed = observed.withColumns({"confidence": F.lit("high"), "via_paths": F.array(F.lit("/"))})
    return resolve.merge_declared(observed, resolve.declared_edges(_hosts(spark, d))).select("from_slug", "to_slug", "confidence")


# The mesh.

_MESH = "with m as (select * from mesh where from_id <> to_id and confidence in ('high', 'corroborated'))"


@query(_MESH + " select from_id, relationship, to_id, confidence from m", ("mesh",))
def mesh_edges(spark, d):
    return graph.mesh_edges(load(spark, d, "mesh"), "high")


@query(_MESH + """
select id, name, cast((select count(*) from m where from_id = id) as bigint) as depends_on_count, cast((select count(*) from m where to_id = id) as bigint) as depended_on_by_count from services""", ("mesh", "services"))
def mesh_degree(spark, d):
    mesh = graph.mesh_edges(load(spark, d, "mesh"), "high")
    return graph.mesh_services(load(spark, d, "services"), mesh).select("id", "name", "depends_on_count", "depended_on_by_count")


@query("""
select cast(symbol_count as bigint) as symbol_count, cast(interface_count as bigint) as interface_count, string_agg(id, ';' order by id) as members from services
where symbol_count <> 0 or interface_count <> 0 group by 1, 2 having count(*) > 1""", ("services",))
def mesh_duplicates(spark, d):
    return graph.likely_duplicates(load(spark, d, "services")).select(F.col("symbol_count").cast("long"), F.col("interface_count").cast("long"), joined("members"))


@query("""
select 'downstream' as side, relationship, to_id as id, name from calls left join objects on id = to_id where from_id = 'nation:3'
union all select 'upstream', relationship, from_id, name from calls left join objects on id = from_id where to_id = 'nation:3'""", ("calls", "objects"))
def one_hop(spark, d):
    return graph.one_hop(load(spark, d, "calls"), load(spark, d, "objects").select("id", "name"), "nation:3").select("side", "relationship", "id", "name")


@query("""
select id, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (select from_id as id, 1 as o, 0 as i from calls union all select to_id, 0, 1 from calls) group by id""", ("calls",))
def degree_of(spark, d):
    return graph.degrees(load(spark, d, "calls"))


@query("""
select 'service:n' || cast(n_nationkey as string) as id, array_to_string(list_sort(list_distinct(list('service:s' || cast(s_suppkey as string))))[1:25], ';') as dependents
from nation join supplier on s_nationkey = n_nationkey group by 1""")
def dependents(spark, d):
    edges = load(spark, d, "supplier").select(F.concat(F.lit("service:s"), "s_suppkey").alias("from_id"), F.concat(F.lit("service:n"), "s_nationkey").alias("to_id"))
    return graph.dependents(edges).select("id", joined("dependents"))


# Traversal.

def _walk_sql(near: str, far: str, depth: int, seed: str) -> str:
    return f"""
with w(id, depth) as ({seed} union select {far}, depth + 1 from w join calls on {near} = id and relationship = 'calls' where depth < {depth}),
r as (select id, min(depth) as depth from w group by id)
select distinct from_id, to_id, name from calls join r on r.id = {near} left join objects on objects.id = {far} where r.depth < {depth} and relationship = 'calls'"""


def _walked(spark, d, seeds: DataFrame, direction: str, depth: int) -> DataFrame:
    edges, objects = load(spark, d, "calls"), load(spark, d, "objects").select("id", "name")
    found, _, _ = graph.walk(edges, seeds, direction, depth, 10**9)
    far = "to_id" if direction == "out" else "from_id"
    return found.join(objects.withColumnRenamed("id", far), far, "left").select("from_id", "to_id", "name")


@query(_walk_sql("from_id", "to_id", 5, "select 'part:20', 0"), ("calls", "objects"))
def bfs_out(spark, d):
    return _walked(spark, d, spark.createDataFrame([("part:20",)], "id string"), "out", 5)


@query(_walk_sql("to_id", "from_id", 2, "select 'nation:7', 0"), ("calls", "objects"))
def bfs_in(spark, d):
    return _walked(spark, d, spark.createDataFrame([("nation:7",)], "id string"), "in", 2)


@query("""
with w(id, depth) as (select to_id, 0 from calls where relationship = 'handled_by' and from_id = 'interface:2' union select to_id, depth + 1 from w join calls on from_id = id and relationship = 'calls' where depth < 3)
select id, cast(min(depth) as bigint) as depth from w group by id""", ("calls",))
def endpoint_trace(spark, d):
    _, reached, _ = graph.endpoint_trace(load(spark, d, "calls"), "interface:2", 3, 10**9)
    return reached.select("id", F.col("depth").cast("long").alias("depth"))


@query("""
select 'r' || cast(r_regionkey as string) as key, '/v1/r' || cast(r_regionkey as string) as prefix from region
union all select 'n' || cast(n_nationkey as string), case when n_nationkey % 3 = 0 then '/v1/r' || cast(n_regionkey as string) || '/only' else
  (case when n_nationkey % 3 = 1 then '/v2/r' else '/v1/r' end) || cast(n_regionkey as string) || '/m/n' || cast(n_nationkey as string) end from nation""")
def prefix_compose(spark, d):
    region, nation = load(spark, d, "region"), load(spark, d, "nation")
    routers = region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.concat(F.lit("/v1/r"), "r_regionkey").alias("own")).unionByName(
        nation.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("/n"), "n_nationkey").alias("own")))
    third = F.col("n_nationkey") % 3
    mounts = nation.select(
        F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.when(third == 0, "/only").otherwise("/m").alias("prefix"),
        F.when(third == 1, "/v2").otherwise("").alias("version"), (third == 0).alias("replaces"))
    return graph.compose_prefixes(routers, mounts)


# Lines and spans.

@query("""
select path, line, symbol, (select arg_max(id, ((s."start" - s."end"), s."start", s.id)) from spans s where s.path = p.path and s."start" <= line and line <= s."end") as id from points p""", ("spans", "points"))
def span_tightest(spark, d):
    return intervals.tightest_span(load(spark, d, "points"), load(spark, d, "spans").select("path", "start", "end", "id")).select("path", "line", "symbol", "id")


@query("""
with fresh as (select path, line, arg_max(id, ((s."start" - s."end"), s."start", s.id)) as id from (select distinct path, line from points) p join spans s using (path) where s."start" <= line and line <= s."end" group by path, line),
defs as (select symbol, min((path, line)) as w from points group by symbol),
callee as (select symbol, id from defs join fresh on fresh.path = w[1] and fresh.line = w[2])
select fresh.id as caller, callee.id as callee, count(*) as weight from points p join fresh using (path, line) join callee using (symbol) where fresh.id <> callee.id group by 1, 2""", ("spans", "points"))
def edge_weight(spark, d):
    points = load(spark, d, "points")
    return intervals.call_graph(points, points.withColumn("pos", F.struct("path", "line")), load(spark, d, "spans").select("path", "start", "end", "id"))


@query("""
with ev as (select distinct path as ref, path, case when line % 5 = 0 then null else line end as lo, line + 3 as hi from points)
select distinct ref, id from ev join spans s using (path) where lo is null or not (hi < s."start" or lo > s."end")""", ("spans", "points"))
def evidence_overlap(spark, d):
    e = F.when(F.col("line") % 5 == 0, F.col("path")).otherwise(F.concat("path", F.lit(":"), "line", F.lit("-"), F.col("line") + 3))
    return intervals.evidence_symbols(load(spark, d, "points").select(F.col("path").alias("ref"), e.alias("e")).distinct(), load(spark, d, "spans"))


_VERSIONS = """with o as (select id, hash from spans where "start" % 7 <> 0), n as (select id, case when "end" % 5 = 0 then 'new' else hash end as hash from spans where "start" % 6 <> 0)"""


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    spans = load(spark, d, "spans")
    return spans.filter("start % 7 <> 0"), spans.filter("start % 6 <> 0").withColumn("hash", F.when(F.col("end") % 5 == 0, "new").otherwise(F.col("hash")))


@query(_VERSIONS + """
select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change
from o full outer join n on o.id = n.id where o.id is null or n.id is null or o.hash <> n.hash""", ("spans",))
def symbol_diff(spark, d):
    return intervals.symbol_diff(*_versions(spark, d))


@query(_VERSIONS + """
select path as ref, bool_or(o.id is null or n.id is null or o.hash <> n.hash) as stale from spans left join o using (id) left join n using (id) group by path""", ("spans",))
def stale_evidence(spark, d):
    spans = load(spark, d, "spans")
    touched = spans.select(F.col("path").alias("ref"), "id")
    return intervals.stale(touched.select("ref").distinct(), touched, *_versions(spark, d))


# Lookup.

@query("""
with t as (select id, name, case when name = 'red bolt' then 1 when starts_with(name, 'red bolt') then 2 when contains(lower(id), 'red bolt') then 3 end as tier from objects where object_type = 'part')
select cast(tier as bigint) as tier, id from t where tier is not null order by tier, case when tier = 2 then name end, id limit 20""", ("objects",))
def find_tiered(spark, d):
    return lookup.find_tiered(load(spark, d, "objects"), " red bolt ", "part").select(F.col("tier").cast("long").alias("tier"), "id")


@query("select id, name from objects where object_type = 'part' and source <> 'relationship_stub' order by id limit 50 offset 10", ("objects",))
def list_page(spark, d):
    return lookup.list_objects(load(spark, d, "objects"), "part", limit=50, offset=10).select("id", "name")


@query("select id, name from objects where starts_with(id, 'supplier:1') and source <> 'relationship_stub'", ("objects",))
def prefix_scan(spark, d):
    return lookup.list_under(load(spark, d, "objects"), "supplier:1").select("id", "name")


@query("""
with w(pos, id) as (values (0, 'nation:5'), (1, 'part:9'), (2, 'none:1'), (3, 'region:0')) select cast(pos as bigint) as pos, id, name from w join objects using (id)""", ("objects",))
def multi_get(spark, d):
    return lookup.get_many(load(spark, d, "objects"), ["nation:5", "part:9", "none:1", "region:0"]).select(F.col("pos").cast("long").alias("pos"), "id", "name")


@query("select * from (select concat('part:', cast(r_regionkey * 20 as string)) as id from region) where id not in (select id from objects) union all select concat('extra:', cast(n_nationkey as string)) from nation", ("objects",))
def missing_stubs(spark, d):
    wanted = load(spark, d, "region").select(F.concat(F.lit("part:"), F.col("r_regionkey") * 20).alias("id")).unionByName(load(spark, d, "nation").select(F.concat(F.lit("extra:"), "n_nationkey").alias("id")))
    return catalog.stubs(wanted, load(spark, d, "objects")).select("id")


@query("select object_type, count(*) as n from objects group by 1", ("objects",))
def count_by_type(spark, d):
    return lookup.by_type(load(spark, d, "objects"))


@query("select (select count(*) from objects) as objects, (select count(distinct object_type) from objects) as types, (select max(ts) from events) as newest, (select count(*) from calls) as edges", ("objects", "calls"))
def index_info(spark, d):
    stamp = load(spark, d, "events").agg(F.max("ts").alias("last_generated_at"))
    return lookup.index_info(load(spark, d, "objects").crossJoin(F.broadcast(stamp)), load(spark, d, "calls"))


# Vectors.

_QUERY = "with q as (select embedding as v from embeddings order by vec_id limit 1), s as (select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(v as double[])), 6) as score from embeddings, q)"


def _first_vector(spark, d) -> list[float]:
    return load(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"]


@query(_QUERY + " select vec_id as id, score from s order by score desc, id limit 10")
def cosine_topk(spark, d):
    return semantic.top_k(load(spark, d, "embeddings"), _first_vector(spark, d), 10, "vec_id", "embedding")


@query(_QUERY + ", k as (select * from s order by score desc, vec_id limit 5) select vec_id as id, doc.lang as name, round(score, 4) as score from k left join documents doc on doc.doc_id = vec_id and doc_id % 2 = 0")
def discover(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("object_id"), F.lit("doc").alias("object_type"), F.lit("m").alias("model"), F.col("embedding").alias("vector"))
    names = load(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("name"))
    return semantic.discover(vectors, names, _first_vector(spark, d), "doc", "m")


@query("""
select item_id, cast(count(*) as bigint) as n from (select distinct item_id, lower(w) as w from (select item_id, unnest(string_split(text, ' ')) as w from benchmark)) join (select distinct lower(p_name) as w from part) using (w) group by 1""")
def vocabulary_overlap(spark, d):
    words = load(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).select("item_id", F.lower("w").alias("w")).distinct()
    return words.join(load(spark, d, "part").select(F.lower("p_name").alias("w")).distinct(), "w", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
select slug, value from (select distinct concat('e', cast(event_id % 50 as string)) as slug, k as value from (select event_id, 'k' as k from events) union select distinct concat('e', cast(event_id % 50 as string)), 'absent' from events)
where value = 'k'""")
def grounding(spark, d):
    events = load(spark, d, "events")
    slug = F.concat(F.lit("e"), F.col("event_id") % 50)
    texts = events.select(slug.alias("slug"), F.col("props").alias("text"))
    proposals = events.select(slug.alias("slug"), F.explode(F.array(F.lit("k"), F.lit("absent"))).alias("value")).distinct()
    return semantic.grounded(proposals, texts)


@query("""
with t as (select lang as slug, concat('f("", "', replace(replace(text, chr(10), ' '), '. ', '.", "'), '")') as text from documents),
p as (select distinct slug, rtrim(w, '.') || '.' as value from (select distinct slug from t where slug is not null), (select unnest(string_split(replace(text, chr(10), ' '), '. ')) as w from benchmark))
select slug, value from p where exists (select 1 from t where t.slug = p.slug and (contains(t.text, '"' || value || '"') or contains(t.text, chr(39) || value || chr(39))))""")
def grounding_passages(spark, d):
    docs = load(spark, d, "documents")
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    texts = docs.select(F.col("lang").alias("slug"), F.concat(F.lit('f("", "'), F.replace(line, F.lit(". "), F.lit('.", "')), F.lit('")')).alias("text"))
    sentences = load(spark, d, "benchmark").select(F.explode(F.split(line, r"\. ")).alias("w")).select(F.concat(F.rtrim("w", F.lit(".")), F.lit(".")).alias("value")).distinct()
    return semantic.grounded(texts.select("slug").filter("slug is not null").distinct().crossJoin(sentences), texts)


@query("""
select doc_id, substr(sha1(concat_ws('|', lang, source, cast(n_chars as string))), 1, 16) as content_hash from documents where doc_id % 3 <> 0 or n_chars % 2 = 0""")
def hash_gate(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), S.content_hash(F.col("lang"), F.col("source"), F.col("n_chars")).alias("content_hash"), "n_chars")
    stored = docs.filter("id % 3 = 0 and n_chars % 2 <> 0")
    return semantic.changed(docs, stored).select(F.col("id").alias("doc_id"), "content_hash")


# Rules.

_RULES = """with r as (select id, title, status, dep, lang from rules), s as (select id, list_distinct([lower(dep_a), lower(dep_b)]) as deps, lang from governed),
g as (select s.id as service, r.id as rule, concat_ws(';', r.dep, r.lang) as matched from r, s where (r.dep is null or list_contains(s.deps, r.dep)) and (r.lang is null or r.lang = s.lang))"""


def _governed(spark, d, tell=F.col) -> tuple[DataFrame, DataFrame]:
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    held = load(spark, d, "rules").select("id", "title", "status", one("dep").alias("dependencies"), one("lang").alias("languages"))
    services = load(spark, d, "governed").select("id", F.array("dep_a", "dep_b").alias("dependencies"), F.array("lang").alias("languages"), F.lit("auto").alias("language"))
    return rules.governed_by(held, services, tell), held


@query(_RULES + " select service, rule, matched from g", ("rules", "governed"))
def rules_overlap(spark, d):
    return _governed(spark, d, joined)[0].select("service", "rule", "matched")


@query(_RULES + " select rule as id, title, status, replace(matched, ';', ', ') as because from g join r on r.id = rule where service = 'supplier:3'", ("rules", "governed"))
def rules_rank(spark, d):
    return rules.governing(*_governed(spark, d), "supplier:3")


# Ranking.

@query("select p_partkey, case when k = 1 then p_name else p_name || '-' || cast(k as string) end as uid from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as k from part)")
def uniquify(spark, d):
    return lookup.unique_ids(load(spark, d, "part"), "p_name", [F.col("p_partkey")]).select("p_partkey", "uid")


@query("""
with t as (select p_name, p_brand, row_number() over (partition by p_brand order by p_partkey) as turn from part), f as (select p_name, min((turn, p_brand)) as x from t group by p_name)
select p_name, cast(x[1] as bigint) as turn, x[2] as p_brand from f order by 2, 3, 1 limit 30""")
def round_robin(spark, d):
    return lookup.round_robin(load(spark, d, "part"), "p_brand", "p_name", [F.col("p_partkey")], 30).select("p_name", F.col("turn").cast("long").alias("turn"), "p_brand")


@query("select p_brand, p_size, p_partkey, p_name from (select *, row_number() over (partition by p_brand, p_size order by p_retailprice, p_partkey) as k from part) where k = 1")
def first_wins(spark, d):
    return resolve.first_wins(load(spark, d, "part"), ["p_brand", "p_size"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_size", "p_partkey", "p_name")


@query("""
with t as (select *, row_number() over (partition by p_brand, p_size order by p_partkey) as k from part), o as (select p_brand, p_size, p_type from t where k = 1)
select p_brand, p_size, o.p_type, string_agg(distinct p_name, ';' order by p_name) as evidence from t join o using (p_brand, p_size) where t.p_type = o.p_type group by 1, 2, 3""")
def merge_first(spark, d):
    rows = load(spark, d, "part").select("p_brand", "p_size", "p_type", "p_partkey", F.array("p_name").alias("evidence"))
    return lookup.merge_first(rows, ["p_brand", "p_size"], [F.col("p_partkey")], "evidence", "p_type").select("p_brand", "p_size", "p_type", joined("evidence"))


@query("select lang, n from (select lang, count(*) as n, sum(count(*)) over () as t from documents group by lang) where n >= 2 and (n >= 20 or n >= 0.05 * t)")
def lang_share(spark, d):
    return quality.shares(load(spark, d, "documents"), "lang")


@query("select w as name, count(*) as n from (select unnest(string_split(regexp_replace(url, '[^/]*$', ''), '/')) as w from pages) where w <> '' group by 1 order by n desc, name limit 25")
def module_vocab(spark, d):
    return quality.vocabulary(load(spark, d, "pages"), "url")


# Scalars.

@query("""
select page_id, regexp_extract(url, '^https?://([^/:?]*)', 1) as host, '/' || regexp_extract(url, '^https?://[^/]*/(.*)$', 1) as path, '' as port from pages""")
def url_split(spark, d):
    u = S.url_to_path("url")
    return load(spark, d, "pages").select("page_id", S.bare_host("url").alias("host"), u["path"].alias("path"), S.bare_port("url").alias("port"))


@query("""
select doc_id, case when regexp_matches(trim(w), '^[A-Za-z0-9+/_-]{24,}={0,2}$') then '[redacted]' else w end as value from (select doc_id, string_split(text, ' ')[1] as w from documents)""")
def redact(spark, d):
    return load(spark, d, "documents").select("doc_id", S.redact(F.element_at(F.split("text", " "), 1)).alias("value"))


@query(r"""
select doc_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(text, '([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]*@', '\1', 'g'), '[ \t\n\r\f"''`]+|[^ \t\n\r\f"''`]+'),
  lambda w: case when regexp_matches(w, '^[A-Za-z0-9+/_-]{24,}={0,2}$') then '[redacted]' else w end), '') as value from documents""")
def redact_texts(spark, d):
    return load(spark, d, "documents").select("doc_id", S.redact_tokens("text").alias("value"))


@query("""
select distinct '/' || lower(p_type) || '/{}/' || cast(p_size as string) as path, concat(lower(p_type), '-size-', cast(p_size as string)) as slug from part""")
def path_norm(spark, d):
    raw = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/{size}/"), F.col("p_size"), F.lit("/"))
    return load(spark, d, "part").select(S.normalize_path(raw).alias("path"), S.path_slug(raw).alias("slug")).distinct()


@query("select distinct p_name, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugs(spark, d):
    return load(spark, d, "part").select("p_name", S.slugish(F.concat_ws(" ", "p_brand", "p_name")).alias("slug")).distinct()


@query("select doc_id, substr(sha1(text), 1, 12) as hash, regexp_extract(text, '^([^\\n]*)', 1) as first_line from documents")
def source_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", S.file_hash("text").alias("hash"), S.source_span("text", F.lit(1), F.lit(1))["text"].alias("first_line"))


@query("select event_type, cast(sum(coalesce(cast(json_extract_string(props, '$.k') as bigint), 0)) as bigint) as k, cast(sum(coalesce(cast(json_extract_string(props, '$.missing') as bigint), 0)) as bigint) as missing from events group by 1")
def json_project(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.sum(S.json_count("props", "k")).alias("k"), F.sum(S.json_count("props", "missing")).alias("missing"))


# Quality.

@query("""
with t as (select distinct doc_id % 10 as qid, lang || '-' || source as item from documents where doc_id % 3 = 0), a as (select distinct doc_id % 10 as qid, lang || '-' || source as item from documents where doc_id % 2 = 0),
c as (select coalesce(t.qid, a.qid) as qid, count(t.item) filter (where a.item is not null) as tp, count(*) filter (where t.item is null) as fp, count(*) filter (where a.item is null) as fn from t full outer join a on t.qid = a.qid and t.item = a.item group by 1),
s as (select *, case when tp + fp > 0 then tp / (tp + fp) when tp + fn = 0 then 1.0 else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) when tp + fp = 0 then 1.0 else 0.0 end as r from c)
select qid, tp, fp, fn, fp as hallucinations, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as f1 from s""")
def f1_by_group(spark, d):
    docs = load(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10).alias("qid"), F.concat_ws("-", "lang", "source").alias("item"))
    truth = docs.filter("doc_id % 3 = 0").groupBy("qid", "item").agg(F.min("doc_id").alias("pos")).withColumn("aliases", F.array().cast("array<string>"))
    answers = docs.filter("doc_id % 2 = 0").select("qid", "item").distinct()
    questions = docs.select("qid").distinct().withColumn("entity", F.lit("service"))
    return quality.score_answers(answers, truth, questions)


@query("""
with v as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as n from events)
select event_type, n, median(value) as p50, min(value) filter (where r >= least(floor(n * 0.95), n - 1)) as p95, min(value) filter (where r >= least(floor(n * 0.99), n - 1)) as p99, max(value) as max from v group by 1, 2""")
def latency_pctl(spark, d):
    return quality.latency(load(spark, d, "events"), "event_type", "value")


# Changes to the stored tables, as the state after them.

@query("""
select from_id, relationship, to_id from calls where not (from_id = 'region:1' or to_id = 'region:1' or starts_with(from_id, 'supplier:1') or starts_with(to_id, 'supplier:1'))""", ("calls",))
def apply_delete(spark, d):
    objects, edges = load(spark, d, "objects"), load(spark, d, "calls")
    none = spark.createDataFrame([], "object_id string, model string")
    return catalog.delete_scope(objects, edges, none, ["region:1"], ["supplier:1"])[1].select("from_id", "relationship", "to_id")


@query("select id, case when id like 'nation:%' then 'renamed' else name end as name from objects union all select 'nation:new', 'renamed'", ("objects",))
def apply_upsert(spark, d):
    objects = load(spark, d, "objects")
    new = objects.filter("object_type = 'nation'").withColumn("name", F.lit("renamed"))
    extra = spark.createDataFrame([("nation:new", "nation", "renamed", "static")], new.schema)
    return catalog.upsert(objects, new.unionByName(extra), ["id"]).select("id", "name")


@query("select from_id, to_id, cast(weight as bigint) as weight from calls where not starts_with(from_id, 'nation:') union all select concat('nation:', cast(n_nationkey as string)), 'region:0', 7 from nation", ("calls",))
def replace_edges(spark, d):
    edges = load(spark, d, "calls")
    nations = load(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    new = nations.select(F.col("id").alias("from_id"), F.lit("calls").alias("relationship"), F.lit("region:0").alias("to_id"), F.lit("static").alias("source"), F.lit(7).alias("weight"))
    return catalog.replace_edges(edges, "static", nations, new).select("from_id", "to_id", F.col("weight").cast("long").alias("weight"))


@query("select from_id, relationship, to_id from calls where from_id in (select id from objects) and to_id in (select id from objects)", ("calls", "objects"))
def valid_edges(spark, d):
    return resolve.valid_edges(load(spark, d, "calls"), load(spark, d, "objects")).select("from_id", "relationship", "to_id")
