"""More registered queries: readers over generated sources, lookups, text functions, the catalog's life, whole-table variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog, fingerprints, index, linking
from ..functions import scalar as S
from ..operators.adjacency import Adjacency
from ..operators import answers, graph, intervals, lookup, quality, resolve, rules, source
from ..schema import EDGES, OBJECTS
from ..sources import deps, files, guidance, manifest, python_code, registry
from ..sources.staging import Staging
from ..streaming.ingest import ingest
from .catalogue import ORACLE, _CALLS, joined, query
from .views import load


def _files(spark, d: str, sql: str, **tables: str) -> DataFrame:
    """(repo, path, content) rows out of SQL over base tables."""
    used = {t: load(spark, d, t) for t in tables or {"nation": ""}}
    text = sql.replace("{", "{{").replace("}", "}}")  # braces are text, but for the tables' names
    for t in used:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    rows = spark.sql(text, **used)
    return rows.select("repo", "path", F.encode("body", "UTF-8").alias("content"))


# Readers over sources generated from the tables.

@query("""
select concat('r', cast(n_regionkey as string)) as slug, 'GET' as method, concat('/v', cast(n_regionkey as string), '/n', cast(n_nationkey as string), '/{id}') as path, concat('f', cast(n_nationkey as string)) as handler,
  concat('n', cast(n_nationkey as string), '.py:3') as evidence from nation
union all select concat('r', cast(r_regionkey as string)), 'POST', '/plain', 'plain', 'main.py:5' from region""")
def python_interfaces(spark, d):
    """Routers of one name in many modules, each mounted under its region's version."""
    modules = _files(spark, d, """
        select concat('r', cast(n_regionkey as string)) as repo, concat('n', cast(n_nationkey as string), '.py') as path,
          concat('from fastapi import APIRouter\\nrouter = APIRouter(prefix="/n', cast(n_nationkey as string), '")\\n@router.get("/{id}")\\ndef f', cast(n_nationkey as string), '(id): ...\\n') as body from {nation}""")
    main = spark.sql("""
        select concat('r', cast(n_regionkey as string)) as repo, 'main.py' as path, concat('from fastapi import FastAPI\\nfrom . import ', array_join(collect_list(concat('n', cast(n_nationkey as string))), ', '), '\\napp = FastAPI()\\n',
          '\\n@app.post("/plain")\\ndef plain(): ...\\n', array_join(collect_list(concat('app.include_router(n', cast(n_nationkey as string), '.router, prefix="/v', cast(n_regionkey as string), '")\\n')), '')) as body
        from {nation} group by n_regionkey""", nation=load(spark, d, "nation")).select("repo", "path", F.encode("body", "UTF-8").alias("content"))
    found = registry.interfaces(registry.discover(modules.unionByName(main)))
    return found.select("slug", "method", "path", "handler", joined("evidence"))


@query("""
select concat('s', cast(s_suppkey as string)) as slug, case when s_suppkey % 2 = 0 then 'GET' else 'POST' end as verb, concat('/stock/', case when s_suppkey % 3 = 0 then '{}' else cast(s_suppkey as string) end) as path,
  case when s_suppkey % 5 = 0 then concat('nation-', cast(s_nationkey as string)) end as host from supplier""")
def python_outbound(spark, d):
    """Literal, f-string and variable addresses of outgoing calls."""
    made = _files(spark, d, """
        select concat('s', cast(s_suppkey as string)) as repo, 'client.py' as path, concat('import httpx\\nasync def f(client, x):\\n    where = ', case when s_suppkey % 3 = 0 then 'f' else '' end, '"',
          case when s_suppkey % 5 = 0 then concat('http://nation-', cast(s_nationkey as string)) else '' end, '/stock/', case when s_suppkey % 3 = 0 then '{x}' else cast(s_suppkey as string) end, '"\\n    await client.',
          case when s_suppkey % 2 = 0 then 'get' else 'post' end, '(where)\\n') as body from {supplier}""", supplier="")
    return python_code.outbound_calls(python_code.read_python(made)).select("slug", "verb", "path", "host")


@query("""
select concat('n', cast(n_nationkey as string)) as slug, m as method, p as path from (
  select n_nationkey, unnest(['GET', 'GET', 'POST', 'GET']) as m, unnest([concat('/api/', lower(substr(n_name, 1, 1)), 's'), concat('/api/', lower(substr(n_name, 1, 1)), 's/:id'), concat('/api/', lower(substr(n_name, 1, 1)), 's/:id/pay'), '/a']) as p from nation)""")
def script_interfaces(spark, d):
    """Rails resources with a member block and an Express route, in one registry."""
    made = _files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, 'config/routes.rb' as path, concat('namespace :api do\\n  resources :', lower(substr(n_name, 1, 1)), 's, only: [:index, :show] do\\n    member { post :pay }\\n  end\\nend\\n') as body from {nation}
        union all select concat('n', cast(n_nationkey as string)), 'a.js', 'const express = require("express")\\nconst app = express()\\napp.get("/a", h)\\n' from {nation}""")
    return registry.interfaces(registry.discover(made)).select("slug", "method", "path")


@query("""
select concat('n', cast(n_nationkey as string)) as slug, 'peers.B_URL' as key, concat('peer-', cast(n_regionkey as string)) as host, case when n_nationkey % 2 = 0 then '8080' else '' end as port from nation""")
def config_hosts(spark, d):
    values = files.config_values(_files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, 'config.json' as path, concat('{"PORT": ', cast(9000 + n_nationkey as string), ', "HOST": "localhost", "peers": {"B_URL": "http://u:p@peer-', cast(n_regionkey as string),
          case when n_nationkey % 2 = 0 then ':8080' else '' end, '/x"}}') as body from {nation}"""))
    return files.host_bindings(values).select("slug", "key", "host", "port")


@query("select concat('n', cast(n_nationkey as string)) as slug, cast(9000 + n_nationkey as string) as port, lower(n_name) as name from nation")
def config_identities(spark, d):
    values = files.config_values(_files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, '.env' as path, concat('export APP_PORT=', cast(9000 + n_nationkey as string), ' # own\\nSERVICE_NAME="', lower(n_name), '"\\n') as body from {nation}"""))
    return files.identities(values)


@query("""
select concat('n', cast(n_nationkey as string)) as slug, concat('chan-', cast(n_regionkey as string)) as channel,
  case n_nationkey % 3 when 0 then 'PUBLISH' when 1 then 'CONSUME' else 'USES' end as direction from nation""")
def config_events(spark, d):
    values = files.config_values(_files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, 'config.json' as path, concat('{"', case n_nationkey % 3 when 0 then 'listen.then.dispatch' when 1 then 'worker' else 'plain' end, '": {"TOPIC_NAME": "chan-',
          cast(n_regionkey as string), '", "LIMIT": 3}}') as body from {nation}"""))
    return files.config_channels(values).select("slug", "channel", "direction")


@query("""
select concat('n', cast(n_nationkey as string)) as repo, unnest([concat('pkg-', cast(n_regionkey as string)), 'rails', 'mod', concat('eg-', cast(n_nationkey as string))]) as dependency from nation""")
def declared_packages(spark, d):
    return deps.declared(_files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, 'package.json' as path, concat('{"dependencies": {"Pkg_', cast(n_regionkey as string), '": "1"}}') as body from {nation}
        union all select concat('n', cast(n_nationkey as string)), 'Gemfile', 'gem "rails", "7"\\n' from {nation}
        union all select concat('n', cast(n_nationkey as string)), 'go.mod', 'module m\\nrequire (\\n\\tgithub.com/x/mod v1\\n)\\n' from {nation}
        union all select concat('n', cast(n_nationkey as string)), 'requirements.txt', concat('git+https://h/o/x.git#egg=Eg_', cast(n_nationkey as string), '\\n') from {nation}"""))


@query("""
select concat('n', cast(n_nationkey as string)) as repo, concat('rule-', cast(n_nationkey as string)) as id, case when n_nationkey % 2 = 0 then 'mandatory' else 'contextual' end as status, 'flask;httpx' as dependencies,
  case when n_nationkey % 5 = 0 then '2024-01-02' else 'never reviewed' end as reviewed, concat('Body of ', n_name, '.') as body from nation where n_nationkey % 7 <> 3""")
def rules_read(spark, d):
    """A rule with an unknown status is refused with an error and is left out here."""
    read = guidance.read_rules(_files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, 'r.md' as path, concat('---\\nid: rule-', cast(n_nationkey as string), '\\ntitle: "T"\\nkind: guidance\\nstatus: ', case when n_nationkey % 7 = 3 then 'maybe' when n_nationkey % 2 = 0
          then 'mandatory' else 'contextual' end, '\\napplies_to:\\n  dependencies: [flask, httpx]\\n', case when n_nationkey % 5 = 0 then 'reviewed: 2024-01-02\\n' else '' end, '---\\nBody of ', n_name, '.\\n') as body from {nation}"""))
    return read.filter("error is null").select("repo", "id", "status", joined("dependencies"), "reviewed", "body")


@query("select concat('n', cast(n_nationkey as string)) as repo, concat('About ', n_name) as description, concat('Serves ', n_name, '.') as opening from nation")
def declared_purpose(spark, d):
    made = _files(spark, d, """
        select concat('n', cast(n_nationkey as string)) as repo, 'package.json' as path, concat('{"description": "About   ', n_name, '"}') as body from {nation}
        union all select concat('n', cast(n_nationkey as string)), 'README.md', concat('# T\\nServes [', n_name, '](http://x).\\n## Install\\nnot this') from {nation}""")
    return manifest.declared_purpose(made).select("repo", F.split("hash_input", "\n")[0].alias("description"), F.split("hash_input", "\n")[1].alias("opening"))


# Lookups, walks and answers.

@query("""
select concat('s', cast(l_suppkey as string)) as slug, count(*) filter (where l_linenumber % 2 = 0) as interfaces, count(*) filter (where l_linenumber % 2 = 1) as symbols from lineitem where l_linenumber <> 3 group by 1""")
def service_counts(spark, d):
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("slug"), F.when(F.col("l_linenumber") % 2 == 0, "interface").otherwise("code_symbol").alias("object_type"), F.when(F.col("l_linenumber") == 3, "relationship_stub").otherwise("static").alias("source"))
    return answers.service_counts(rows)


@query('select from_id as "from", to_id as "to", case when from_id like \'nation:%\' then 1 else weight end as weight from calls', ("calls",))
def edge_cards(spark, d):
    calls = load(spark, d, "calls")
    return answers.edge_cards(calls.withColumn("weight", F.when(~F.col("from_id").startswith("nation:"), F.col("weight"))))


@query("select id, 1 as depth from (select distinct to_id as id from calls where from_id = 'part:20' and relationship = 'calls' order by id limit 4)", ("calls",))
def walk_capped(spark, d):
    """Five nodes in all, the seed counted: the first by the edge that led to them."""
    return graph.walk(load(spark, d, "calls"), spark.createDataFrame([("part:20",)], "id string"), "out", 1, 5)[1]


@query("""
with tight as (select p.path, p.line, s.id, row_number() over (partition by p.path, p.line order by s."end" - s.start, s.start desc, s.id desc) as k from (select distinct path, line from points) p join spans s on p.path = s.path and p.line between s.start and s."end")
select distinct concat('i-', p.symbol) as from_id, t.id as to_id from points p join tight t on p.path = t.path and p.line = t.line and k = 1""", ("points", "spans"))
def handlers(spark, d):
    ends = load(spark, d, "points").select(F.concat(F.lit("i-"), "symbol").alias("id"), F.array(F.concat_ws(":", "path", "line")).alias("evidence"))
    return intervals.handler_edges(ends, load(spark, d, "spans"))


@query("select concat('rule-', cast(p_partkey as string)) as id from part where p_size % 2 = 1 and p_brand in (select p_brand from part where p_size = 7)")
def rules_withdrawn(spark, d):
    part = load(spark, d, "part").select(F.concat(F.lit("rule-"), "p_partkey").alias("id"), F.col("p_brand").alias("root"), "p_size")
    return rules.withdrawn(part, part.filter("p_size % 2 = 0"), part.filter("p_size = 7")).select("id")


@query("select concat('a', cast(p_partkey as string)) as name, 'a1' as declared from part where p_partkey > 1")
def alias_chains(spark, d):
    """Every number is an alias of its half, down to one."""
    rows = load(spark, d, "part").filter("p_partkey > 1").select(F.concat(F.lit("a"), "p_partkey").alias("name"), F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 2)).alias("target"))
    return graph.resolve_aliases(rows)


@query("""
select t.tail, min(k) as key from (select distinct concat('m', cast(n_nationkey as string), '.router') as tail from nation) t
join (select distinct concat('src.p', cast(s_suppkey % 7 as string), '.m', cast(s_nationkey as string), '.router') as k from supplier) on ends_with(k, concat('.', t.tail)) group by 1 having count(*) = 1""")
def unique_tails(spark, d):
    keys = load(spark, d, "supplier").select(F.concat(F.lit("src.p"), F.col("s_suppkey") % 7, F.lit(".m"), "s_nationkey", F.lit(".router")).alias("key"))
    return intervals.unique_tail(load(spark, d, "nation").select(F.concat(F.lit("m"), "n_nationkey", F.lit(".router")).alias("tail")), keys)


@query("""
select l_returnflag as reason, count(*) as n, cast(0 as bigint) as unreadable from lineitem where l_linestatus = 'F' group by 1
union all select 'unparseable', count(*), count(*) from lineitem where l_linestatus <> 'F' having count(*) > 0""")
def skip_reasons(spark, d):
    return source.skip_reasons(load(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("unparseable").alias("reason")))


@query("""
select concat('d', cast(doc_id as string)) as id, case when text is null then 'unavailable' when doc_id % 3 = 0 then 'span_mismatch' else 'ok' end as status,
  case when text is not null and doc_id % 3 <> 0 then array_to_string(string_split(text, chr(10))[1:2], chr(10)) end as text from documents""")
def source_spans(spark, d):
    """Every third text is not the one that was indexed."""
    docs = load(spark, d, "documents")
    symbols = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(S.file_hash(F.coalesce("text", F.lit("")))).alias("file_sha"))
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("rank"), "text")
    return source.get_source(symbols, texts).select("id", "status", F.col("span.text").alias("text"))


@query("select event_type, count(*) as n, round(avg(case when event_id % 3 <> 0 then value else 0 end), 4) as value from events group by 1")
def runs_summary(spark, d):
    return quality.summarise(load(spark, d, "events").withColumn("scored", F.col("event_id") % 3 != 0), ["event_type"], ["value"])


@query("select concat('v', cast(vec_id as string)) as id, concat('s', cast(vec_id as string)) as summary from embeddings")
def summaries(spark, d):
    """The summary of the first model by name; an empty one is none."""
    e = load(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("object_id"), F.concat(F.lit("s"), "vec_id").alias("s"))
    rows = [e.select("object_id", F.lit(m).alias("model"), (F.col("s") if keep else F.lit(text)).alias("summary")) for m, keep, text in (("a", False, ""), ("b", True, ""), ("c", False, "other"))]
    return answers.any_summary(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query("select concat('interface:s', cast(l_suppkey as string), ':', cast(l_orderkey as string)) as id from lineitem where l_suppkey = 3 union all select 'service:s3'")
def owned(spark, d):
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("interface:s"), "l_suppkey", F.lit(":"), "l_orderkey").alias("id"), F.lit("interface").alias("object_type"))
    services = load(spark, d, "supplier").select(F.concat(F.lit("service:s"), "s_suppkey").alias("id"), F.lit("service").alias("object_type"))
    return answers.owned_by(rows.unionByName(services), "s3").select("id")


@query("select concat('s', cast(s_suppkey as string)) as id from supplier where s_suppkey % 4 <> 3")
def matchable_services(spark, d):
    some = lambda k: F.when(F.col("s_suppkey") % 4 == k, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), some(0).alias("dependencies"), some(1).alias("languages"), F.when(F.col("s_suppkey") % 4 == 2, "ruby").otherwise("auto").alias("language"))
    return rules.matchable(rows).select("id")


@query("""
select user_id as id, concat('{"type":"result","modelUsage":{"m":{"inputTokens":', cast(max(event_id) as string), ',"outputTokens":2},"k":{"inputTokens":1}}}') as result, max(event_id) + 1 as input_tokens, cast(2 as bigint) as output_tokens
from events group by user_id""")
def run_usage(spark, d):
    line = F.concat(F.lit('{"type":"result","modelUsage":{"m":{"inputTokens":'), F.col("event_id").cast("string"), F.lit(',"outputTokens":2},"k":{"inputTokens":1}}}'))
    return quality.usage(load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), line.alias("line"))).select("id", "result", "input_tokens", "output_tokens")


@query("""
select id, round(cos(k * 2 * pi() / 25), 6) + 0.0 as x, round(sin(k * 2 * pi() / 25), 6) + 0.0 as y from (select concat('n', cast(n_nationkey as string)) as id, row_number() over (order by concat('n', cast(n_nationkey as string))) - 1 as k from nation)""")
def circle(spark, d):
    return graph.layout(load(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), 25)


@query("select user_id, max(ts) as ts from events group by user_id")
def latest_events(spark, d):
    return catalog.latest(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
select from_id, to_id, confidence from (
  select a.id as from_id, b.id as to_id, case count(*) % 4 when 0 then 'config' when 1 then 'ambiguous' when 2 then 'high' else 'corroborated' end as confidence
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join services a on a.port = cast(9000 + c_nationkey as string) join services b on b.port = cast(9000 + s_nationkey as string) group by 1, 2)
where from_id <> to_id and confidence <> 'config'""", ("services",))
def mesh_of_all_lines(spark, d):
    """The mesh over every line item, from a floor that leaves out what only configuration says."""
    services = load(spark, d, "services").select("id", (F.col("port").cast("int") - 9000).alias("n"))
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n_"))
    label = F.element_at(F.array(*map(F.lit, ("config", "ambiguous", "high", "corroborated"))), (F.col("n_") % 4 + 1).cast("int"))
    ends = pairs.join(services.toDF("from_id", "c_nationkey"), "c_nationkey").join(services.toDF("to_id", "s_nationkey"), "s_nationkey")
    edges = ends.select("from_id", F.lit("calls").alias("relationship"), "to_id", F.lit("static").alias("source"), label.alias("confidence"))
    return graph.mesh_edges(edges, "ambiguous").select("from_id", "to_id", "confidence")


@query("""
select coalesce(source, '') as qid, count(*) filter (where quality = 1 and toxic = 0) as tp, count(*) filter (where quality = 0 and toxic = 0) as fp, count(*) filter (where quality = 1 and toxic = 1) as fn
from documents join labels using (doc_id) group by 1""")
def scores_of_labels(spark, d):
    """Per source: documents named harmless against documents of quality, over all labelled documents."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(F.coalesce("source", F.lit("")).alias("qid"), F.concat(F.lit("d"), "doc_id").alias("item"), "quality", "toxic", "doc_id")
    truth = rows.filter("quality = 1").select("qid", F.col("doc_id").alias("pos"), "item", F.array().cast("array<string>").alias("aliases"))
    questions = rows.select("qid").distinct().withColumn("entity", F.lit("service"))
    return quality.score_answers(rows.filter("toxic = 0").select("qid", "item"), truth, questions).select("qid", "tp", "fp", "fn")


# Text and dates.

@query("""
with t as (select doc_id, trim(coalesce(text, ''), ' ') as t from documents), f as (select doc_id, trim(case when regexp_matches(t, '[.!?]\\s') then regexp_extract(t, '(?s)^(.*?[.!?])\\s', 1) else t end, ' ') as s from t)
select doc_id, case when length(s) <= 200 then s else concat(regexp_replace(substr(s, 1, 200), ' [^ ]*$', ''), '…') end as first from f""")
def first_sentences(spark, d):
    return load(spark, d, "documents").select("doc_id", S.first_sentence("text").alias("first"))


@query("""
select event_id, case event_id % 3 when 0 then concat('@scope/pkg_', cast(event_id as string)) when 1 then concat('my-lib-', cast(event_id as string)) else concat('plain-', cast(event_id as string)) end as name,
  case event_id % 2 when 0 then concat('eg.', cast(event_id as string)) else concat('repo', cast(event_id as string)) end as package from events""")
def package_names(spark, d):
    events = load(spark, d, "events")
    number = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" @Scope/Pkg_"), number)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("github.com/x/My_Lib_"), number)).otherwise(F.concat(F.lit("Plain_"), number))
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("git+https://h/o/x.git@1&egg=eg."), number)).otherwise(F.concat(F.lit("https://h/o/repo"), number, F.lit(".tar.gz/ ; python_version > 3")))
    return events.select("event_id", S.dependency_name(raw).alias("name"), S.url_requirement(line).alias("package"))


@query("""
select p_partkey, substr(concat_ws(' ', trim(p_name), p_type), 1, 1500) as text, lower(p_brand) not like '%#%' as valid,
  case when p_size % 3 = 0 then 'box' when p_size % 3 = 1 then 'company' else 'class' end as one from part""")
def part_texts(spark, d):
    word = F.when(F.col("p_size") % 3 == 0, "boxes").when(F.col("p_size") % 3 == 1, "companies").otherwise("class")
    return load(spark, d, "part").select("p_partkey", S.embed_text(F.concat(F.lit("  "), "p_name"), F.lit(" "), F.col("p_type")).alias("text"), S.valid_alias(F.lower("p_brand")).alias("valid"), S.singular(word).alias("one"))


@query("""
select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as build, cast(greatest(ceil((epoch(ts) - epoch(timestamp '2024-01-01 00:00:00')) / 86400), 0) as int) as days from events""")
def build_stamps(spark, d):
    ts = F.col("ts").cast("timestamp")
    return load(spark, d, "events").select("event_id", S.build_id(F.date_trunc("second", ts)).alias("build"), S.days_left(ts, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("days"))


@query("""
select doc_id, array_to_string(string_split(text, chr(10))[1:4], chr(10)) as around from documents where text is not null""")
def snippets(spark, d):
    return load(spark, d, "documents").filter("text is not null").select("doc_id", S.snippet("text", F.lit(2), F.lit(3), 1).alias("around"))


# The catalog's life.

def _objects(spark, d: str) -> DataFrame:
    rows = load(spark, d, "objects")
    kinds = {f.split(" ")[0]: f.split(" ", 1)[1] for f in OBJECTS.split(", ")}
    return rows.select(*(F.col(c) if c in rows.columns else (F.lit("{}") if c == "payload" else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


@query("select id, name from objects", ("objects",))
def streamed_ingest(spark, d):
    """A file stream into a fresh catalog, twice: the second run finds nothing new."""
    staging = Staging(spark, "ingest")
    _objects(spark, d).drop("last_generated_at").write.json(f"{staging.root}/in")
    held = catalog.Catalog(spark, f"{staging.root}/catalog")
    for _ in range(2):
        ingest(spark, f"{staging.root}/in", held, f"{staging.root}/state").awaitTermination()
    return held.table("objects").select("id", "name")


@query("""
select 'pinned' as reader, id from objects where object_type = 'nation' union all select 'newest', id from objects where object_type = 'nation' and id <> 'nation:3' union all select 'newest', 'nation:new'""", ("objects",))
def catalog_versions(spark, d):
    """A pinned reader keeps its version through a removal and an upsert."""
    root = f"{Staging(spark, 'versions').root}/catalog"
    held = catalog.Catalog(spark, root)
    nations = _objects(spark, d).filter("object_type = 'nation'")
    held.upsert_objects(nations)
    held.pin("before")
    held.delete(["nation:3"])
    held.upsert_objects(nations.limit(1).withColumn("id", F.lit("nation:new")))
    pinned = catalog.Catalog(spark, root, "before").table("objects").select(F.lit("pinned").alias("reader"), "id")
    return pinned.unionByName(held.table("objects").select(F.lit("newest").alias("reader"), "id"))


@query("select id from objects where object_type = 'supplier' and contains(lower(id), '1') order by id limit 5", ("objects",))
def near_ids(spark, d):
    """What is suggested for an id that is not there: its last segment among the names, then within the ids."""
    return lookup.suggest(load(spark, d, "objects"), "supplier:none:1", "supplier").select("id")


# Channels that services share, and what a catalog keeps for lookups and of whole repositories.

_BUSY = "with e as (select slug, substr(path, 6) as channel, method, framework from busy)"


@query(_BUSY + """
select p.slug as from_slug, c.slug as to_slug, array_to_string(list_sort(list_distinct(list(p.channel)))[1:20], ';') as channels,
  case when bool_or(p.framework = 'config' or c.framework = 'config') then 'config' else 'static' end as confidence
from e p join e c on p.channel = c.channel and p.method = 'PUBLISH' and c.method in ('CONSUME', 'USES') and p.slug <> c.slug group by 1, 2""", ("busy",))
def channels_published(spark, d):
    """Publishers and consumers of shared channels, under the prefix of any environment."""
    return resolve.publish_edges(resolve.channel_ends(load(spark, d, "busy"))).select("from_slug", "to_slug", joined("channels"), "confidence")


@query(_BUSY + """
select a.slug as from_slug, b.slug as to_slug, array_to_string(list_sort(list_distinct(list(a.channel)))[1:20], ';') as channels, 'direction-unknown' as confidence
from e a join e b on a.channel = b.channel and a.slug < b.slug where a.channel not in (select channel from e where method = 'PUBLISH') group by 1, 2""", ("busy",))
def channels_unpublished(spark, d):
    return resolve.shared_edges(resolve.channel_ends(load(spark, d, "busy"))).select("from_slug", "to_slug", joined("channels"), "confidence")


@query("""
with q as (select unnest(['red bolt', 'r:1', '#00', '9']) as q),
t as (select q, id, name, case when name = q then 1 when starts_with(name, q) then 2 when contains(lower(id), q) then 3 end as tier from objects, q where object_type = 'supplier'),
n as (select *, row_number() over (partition by q order by tier, case when tier = 2 then name end, id) as k from t where tier is not null)
select q, cast(tier as bigint) as tier, id from n where k <= 20""", ("objects",))
def find_by_trigrams(spark, d):
    """Tiered lookups on the names and trigrams that a catalog keeps; the twentieth hit ends the answer, as in ``find_tiered``."""
    held = catalog.Catalog(spark, f"{Staging(spark, 'lookup').root}/catalog")
    held.commit(objects=_objects(spark, d))
    held.build_lookup()
    out = None
    for q in ("red bolt", "r:1", "#00", "9"):
        rows = lookup.find_indexed(held.lookup(), q, "supplier").select(F.lit(q).alias("q"), F.col("tier").cast("long").alias("tier"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
with n as (select n_nationkey as k, (n_nationkey * 7 + 3) % 25 as peer from nation)
select 'calls' as relationship, concat('service:n', k) as from_id, concat('service:n', peer) as to_id, 'corroborated' as said from n where peer <> k and k % 3 <> 0
union all select 'handled_by', concat('interface:n', k, ':get-items', k, '-id'), concat('code_symbol:n', k, ':app.py::item'), null from n
union all select 'governed_by', concat('service:n', k), 'guidance:flask-first', 'flask' from n where k % 2 = 0
union all select 'skipped', concat('service:n', k), 'app.py', 'non-literal-url' from n where k % 3 = 0
union all select 'calls', concat('code_symbol:n', k, ':app.py::item'), concat('code_symbol:n', k, ':app.py::ask'), '1' from n where k % 5 = 0""")
def indexed_fleet(spark, d):
    """A repository per nation and one of rules, indexed into a catalog: its edges, and the sites that could not be read."""
    nation = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string").alias("peer"))
    k = F.col("k").cast("string")
    address = F.when(F.col("k") % 3 == 0, "address(id)").otherwise(F.concat(F.lit("f'http://n"), "peer", F.lit("/items"), "peer", F.lit("/{id}'")))
    app = F.concat(F.lit("from flask import Flask\nimport requests\napp = Flask(__name__)\n\n@app.route('/items"), k, F.lit("/<id>')\ndef item(id):\n    return ask(id)\n\ndef ask(id):\n    return requests.get("), address, F.lit(")\n"))
    byte = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))  # noqa: E731  one field of a binary code index, shorter than 128 bytes
    text = lambda tag, body: F.concat(F.lit(bytes([tag])), byte(F.length(body)), body)
    site = lambda symbol, line, role: text(0x12, F.concat(text(0x0A, F.lit(bytes([line, 0, 1]))), text(0x12, F.lit(symbol.encode())), F.lit(bytes([0x18, role]))))
    scip = text(0x12, F.concat(text(0x0A, F.lit(b"app.py")), site("item", 5, 1), site("ask", 6, 0), site("ask", 8, 1)))
    file = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    made = nation.select(F.concat(F.lit("n"), k).alias("repo"), F.explode(F.array(
        file(F.lit("app.py"), F.encode(app, "UTF-8")), file(F.lit("requirements.txt"), F.encode(F.when(F.col("k") % 2 == 0, "flask").otherwise("requests"), "UTF-8")),
        file(F.when(F.col("k") % 5 == 0, "index.scip").otherwise("none.txt"), scip))).alias("f")).select("repo", "f.*")
    rule = "---\nkind: guidance\nid: flask-first\ntitle: Flask first\nstatus: mandatory\napplies_to:\n  dependencies: [flask]\n---\nUse it.\n"
    books = F.array(file(F.lit("weftgraph.yaml"), F.lit(b"guidance: [rules]\n")), file(F.lit("rules/a.md"), F.lit(rule.encode())))
    book = load(spark, d, "region").filter("r_regionkey = 0").select(F.lit("book").alias("repo"), F.explode(books).alias("f")).select("repo", "f.*")
    held = catalog.Catalog(spark, f"{Staging(spark, 'fleet').root}/catalog")
    index.index(held, made.unionByName(book))
    services = answers.payload(held.table("objects"), "service")
    said = F.coalesce("confidence", F.array_join("matched", ","), F.col("weight").cast("string"))
    return held.table("edges").select("relationship", "from_id", "to_id", said.alias("said")).unionByName(
        services.select(F.lit("skipped").alias("relationship"), F.col("id").alias("from_id"), F.explode("skipped").alias("s")).select("relationship", "from_id", F.col("s.file").alias("to_id"), F.col("s.reason").alias("said")))


# Links of a fleet of which every third provider moves its interface and every seventh withdraws it.

_MOVED = """(select concat('s', cast(s_suppkey as string)) as slug,
    concat('/brand-', cast((s_suppkey + case when s_suppkey % 3 = 0 then 1 else 0 end) % 25 + 1 as string), '/size-', cast(s_suppkey % 50 + 1 as string), '/:id') as path from supplier where s_suppkey % 7 <> 1)"""


@query(_CALLS.replace("from interfaces", f"from {_MOVED} moved").replace("from outbound", "from callers") + """
select concat('service:', slug) as from_id, concat('service:', provider) as to_id,
  case when bool_or(coalesce(contains(host, provider), false)) then 'corroborated' when arg_min(k, pos) = 1 then 'high' else 'ambiguous' end as confidence,
  array_to_string(list_sort(list_distinct(list(path)))[1:10], ';') as via_paths
from hits group by slug, provider""", ("callers",))
def relinked_calls(spark, d):
    """All customers call all suppliers; linked whole, then brought up to date by what the suppliers changed."""
    def as_objects(rows: DataFrame, kind: str, payload) -> DataFrame:
        fixed = {"id": F.concat_ws(":", F.lit(kind), "slug", *(["path"] if kind == "interface" else [])), "object_type": F.lit(kind), "slug": F.col("slug"), "source": F.lit("static"), "payload": F.to_json(payload)}
        return rows.select(*(fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in (f.split(" ") for f in OBJECTS.split(", "))))

    call = F.struct(F.col("pos"), F.col("verb"), F.col("path"), F.col("host"))
    callers = load(spark, d, "callers").groupBy("slug").agg(F.array_sort(F.collect_list(call)).alias("outbound"))
    providers = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    services = as_objects(callers, "service", F.struct("outbound")).unionByName(as_objects(providers, "service", F.struct(F.lit(1).alias("interface_count"))))
    offer = lambda shift: F.concat(F.lit("/brand-"), ((F.col("s_suppkey") + shift) % 25 + 1).cast("string"), F.lit("/size-"), (F.col("s_suppkey") % 50 + 1).cast("string"), F.lit("/:id"))
    interfaces = lambda rows: as_objects(rows, "interface", F.struct(F.lit("rest").alias("type"), F.lit("GET").alias("method"), "path"))
    staging = Staging(spark, "relinked")
    services = staging.save(services, "services")
    held = catalog.Catalog(spark, f"{staging.root}/catalog")
    held.commit(objects=services.unionByName(interfaces(providers.withColumn("path", offer(F.lit(0))))), edges=spark.createDataFrame([], EDGES))
    linking.relink(held)
    moved = providers.filter("s_suppkey % 7 <> 1").withColumn("path", offer(F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)))
    held.commit(objects=services.unionByName(interfaces(moved)))
    linking.relink_changed(held)
    return held.table("edges").select("from_id", "to_id", "confidence", joined("via_paths"))


# Kept edges and kept facts.

@query(ORACLE["bfs_out"])
def bfs_out_kept(spark, d):
    """The walk of ``bfs_out`` over edges that are kept bucketed by their ends."""
    staging = Staging(spark, "kept-edges")
    kept = Adjacency.build(load(spark, d, "calls"), f"{staging.root}/edges")
    found, _, _ = graph.walk(kept, spark.createDataFrame([("part:20",)], "id string"), "out", 5, 10**9)
    return found.join(load(spark, d, "objects").select(F.col("id").alias("to_id"), "name"), "to_id", "left").select("from_id", "to_id", "name")


@query("""
with old as (select coalesce(source, '') as repo, concat('d', doc_id % 13, '/e', doc_id % 3, '/', doc_id, '.txt') as path, coalesce("text", '') as t from documents),
new as (select coalesce(source, '') as repo, concat(case when doc_id % 11 = 4 then 'moved/' else '' end, 'd', doc_id % 13, '/e', doc_id % 3, '/', doc_id, '.txt') as path,
  concat(coalesce("text", ''), case when doc_id % 5 = 0 then '.' else '' end) as t from documents where doc_id % 7 <> 3)
select repo, path, case when old.t is null then 'added' when new.t is null then 'removed' else 'changed' end as change from old full join new using (repo, path) where old.t is distinct from new.t""")
def changed_files(spark, d):
    """Documents as files, the source as their repository: what was moved, changed and removed, by the trees of both states."""
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("repo"), F.coalesce("text", F.lit("")).alias("t"))
    path = F.concat(F.lit("d"), F.col("doc_id") % 13, F.lit("/e"), F.col("doc_id") % 3, F.lit("/"), "doc_id", F.lit(".txt"))
    old = docs.select("repo", path.alias("path"), F.encode("t", "UTF-8").alias("content"))
    moved, more = F.when(F.col("doc_id") % 11 == 4, "moved/").otherwise(""), F.when(F.col("doc_id") % 5 == 0, ".").otherwise("")
    new = docs.filter("doc_id % 7 <> 3").select("repo", F.concat(moved, path).alias("path"), F.encode(F.concat("t", more), "UTF-8").alias("content"))
    staging = Staging(spark, "trees")
    a, b = (staging.save(fingerprints.leaves(files), name) for files, name in ((old, "old"), (new, "new")))
    return fingerprints.changes((a, fingerprints.nodes(a)), (b, fingerprints.nodes(b)))


@query("""
select concat('n', s_nationkey) as repo, concat('s', s_suppkey, '.py') as file, concat(case when s_suppkey % 3 = 0 then 'new' else 'old' end, s_suppkey) as name from supplier where s_suppkey % 7 <> 1
union all select 'seen', 'read', cast(count(*) as varchar) from supplier where s_suppkey % 7 <> 1 and s_suppkey % 3 = 0""")
def kept_facts(spark, d):
    """A module per supplier, read once; then every third changes and every seventh goes: names after the refresh, and how many files that read."""
    suppliers = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), "s_nationkey").alias("repo"), F.concat(F.lit("s"), "s_suppkey", F.lit(".py")).alias("path"))
    module = lambda word: F.encode(F.concat(F.lit("def "), word, "s_suppkey", F.lit("(): ...\n")), "UTF-8").alias("content")
    store = fingerprints.FactStore(spark, f"{Staging(spark, 'kept').root}/facts")
    store.refresh(suppliers.select("repo", "path", module(F.lit("old"))))
    now = suppliers.filter("s_suppkey % 7 <> 1").select("repo", "path", module(F.when(F.col("s_suppkey") % 3 == 0, "new").otherwise("old")))
    report = store.refresh(now)[1]
    names = store.load(now).filter("fact = 'symbol'").select("repo", "file", "name")
    return names.unionByName(spark.createDataFrame([("seen", "read", str(report["read"]))], "repo string, file string, name string"))
