"""Graph-shaped views over the star-schema tables, in SQL that Spark and DuckDB both read.

``{name}`` is a base table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fleet": "select concat('s', cast(s_suppkey as string)) as slug from {supplier} union all select concat('n', cast(n_nationkey as string)) as slug from {nation}",
    "interfaces": """
        select concat('s', cast(s_suppkey as string)) as slug, 'rest' as type, 'GET' as method,
          concat('/brand-', cast(s_suppkey % 25 + 1 as string), '/size-', cast(s_suppkey % 50 + 1 as string), '/:id') as path, '' as framework
        from {supplier}""",
    "outbound": """
        select concat('n', cast(c_nationkey as string)) as slug,
          row_number() over (partition by c_nationkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as pos,
          'get' as verb,
          case when l_discount = 0 then '/' else concat('/', replace(lower(p_brand), '#', '-'), '/size-', cast(p_size as string), '/', cast(p_partkey as string)) end as path,
          case when l_linenumber % 7 = 0 then 'cdn.vendor.example' when l_linenumber % 2 = 1 then concat('s', cast(l_suppkey as string)) end as host
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {part} on l_partkey = p_partkey""",
    "callers": """
        select concat('c', cast(c_custkey as string)) as slug,
          row_number() over (partition by c_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as pos,
          'get' as verb,
          case when l_discount = 0 then '/' else concat('/', replace(lower(p_brand), '#', '-'), '/size-', cast(p_size as string), '/', cast(p_partkey as string)) end as path,
          case when l_linenumber % 7 = 0 then 'cdn.vendor.example' when l_linenumber % 2 = 1 then concat('s', cast(l_suppkey as string)) end as host
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {part} on l_partkey = p_partkey""",
    "ends": """
        select concat('u', cast(user_id % 40 as string)) as slug, 'event' as type,
          case when event_type = 'error' or event_id % 3 = 2 then 'USES' when event_id % 3 = 0 then 'PUBLISH' else 'CONSUME' end as method,
          concat(case when event_id % 2 = 0 then 'stag' else 'prod' end, '-', event_type, '-', cast(user_id as string)) as path,
          case when event_id % 5 = 0 then 'config' else 'messaging' end as framework
        from {events}""",
    "busy": """
        select concat('u', cast(user_id % 40 as string)) as slug, 'event' as type,
          case when event_id % 12 < 4 then (case when event_id % 2 = 0 then 'USES' else 'CONSUME' end) when cast(floor(event_id / 12) as int) % 3 = 0 then 'PUBLISH' when cast(floor(event_id / 12) as int) % 3 = 1 then 'CONSUME' else 'USES' end as method,
          concat(case when event_id % 5 = 0 then 'stag' else 'prod' end, '-', case when event_id % 7 = 0 then 'all' else event_type end, '-', cast(event_id % 12 as string)) as path,
          case when event_id % 31 = 0 then 'config' else 'messaging' end as framework
        from {events}""",
    "services": """
        select concat('service:', replace(lower(n_name), ' ', '-')) as id, replace(lower(n_name), ' ', '-') as slug, n_name as name, cast(9000 + n_nationkey as string) as port,
          n_nationkey % 4 as symbol_count, n_regionkey as interface_count
        from {nation}""",
    "bindings": """
        select concat('c', cast(c_custkey as string)) as slug,
          case when c_custkey % 5 = 3 then concat('PEERS.', upper(replace(t.slug, '-', '_')), '_HOST') else 'PEER.HOST' end as `key`,
          case c_custkey % 5 when 0 then concat('http://', t.slug, '.default.svc.cluster.local:80/v1') when 1 then concat('https://', t.slug, '-api:8080') when 2 then concat('localhost:', t.port)
            when 3 then '' else 's3.amazonaws.com' end as value
        from {customer} join {nation} on n_nationkey = (c_custkey * 7) % 25 join {services} t on t.name = n_name""",
    "mesh": """
        select a.id as from_id, 'calls' as relationship, b.id as to_id, 'static' as source,
          case when count(*) % 4 = 0 then 'config' when count(*) % 4 = 1 then 'ambiguous' when count(*) % 4 = 2 then 'high' else 'corroborated' end as confidence
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey
          join {nation} x on x.n_nationkey = c_nationkey join {nation} y on y.n_nationkey = s_nationkey
          join {services} a on a.name = x.n_name join {services} b on b.name = y.n_name
        where l_linenumber = 1 group by a.id, b.id""",
    "calls": """
        select concat('part:', cast(l_partkey as string)) as from_id, 'calls' as relationship, concat('supplier:', cast(l_suppkey as string)) as to_id, 'static' as source, cast(count(*) as int) as weight
          from {lineitem} group by l_partkey, l_suppkey
        union all select concat('supplier:', cast(s_suppkey as string)), 'calls', concat('nation:', cast(s_nationkey as string)), 'static', 1 from {supplier}
        union all select concat('nation:', cast(n_nationkey as string)), 'calls', concat('region:', cast(n_regionkey as string)), 'static', 1 from {nation}
        union all select concat('region:', cast(r_regionkey as string)), 'calls', concat('part:', cast(r_regionkey * 20 as string)), 'static', 1 from {region}
        union all select concat('interface:', cast(r_regionkey as string)), 'handled_by', concat('nation:', cast(r_regionkey * 3 as string)), 'static', 1 from {region}""",
    "objects": """
        select concat('part:', cast(p_partkey as string)) as id, 'part' as object_type, p_name as name, case when p_size = 1 then 'relationship_stub' else 'static' end as source from {part}
        union all select concat('supplier:', cast(s_suppkey as string)), 'supplier', s_name, 'static' from {supplier}
        union all select concat('nation:', cast(n_nationkey as string)), 'nation', n_name, 'static' from {nation}
        union all select concat('region:', cast(r_regionkey as string)), 'region', r_name, 'static' from {region}""",
    "spans": """
        select concat('f', cast(o_custkey as string)) as path, concat('sym', cast(o_orderkey as string)) as id, cast(o_orderkey % 97 as int) as `start`,
          cast(o_orderkey % 97 + o_custkey % 13 + o_orderkey % 40 as int) as `end`, substr(cast(o_orderkey * 7919 as string), 1, 3) as hash
        from {orders}""",
    "points": """
        select concat('f', cast(o_custkey as string)) as path, cast(l_partkey % 137 as int) as line, concat('g', cast(l_partkey % 997 as string)) as symbol
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "rules": """
        select concat('rule-', cast(p_partkey as string)) as id, p_name as title, case p_partkey % 4 when 0 then 'mandatory' when 1 then 'recommended' when 2 then 'contextual' else 'draft' end as status,
          case when p_partkey % 3 = 0 then cast(null as string) else lower(p_brand) end as dep, case when p_partkey % 6 < 3 then cast(null as string) else concat('lang', cast(p_size % 5 as string)) end as lang
        from {part} where p_partkey % 3 <> 0 or p_partkey % 6 >= 3""",
    "governed": """
        select concat('supplier:', cast(s_suppkey as string)) as id, concat('Brand#', cast(s_suppkey % 25 + 1 as string)) as dep_a, concat('BRAND#', cast(s_suppkey % 7 + 11 as string)) as dep_b, concat('lang', cast(s_suppkey % 5 as string)) as lang
        from {supplier}""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over them; only what a query reads is planned."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t: load(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of calls whose ``pos`` is what its number is counted by: in the same order, and no service is sorted in one task."""
    sql = re.sub(r"row_number\(\) over \(partition by \w+ order by ([^()]*)\)", r"struct(\1)", VIEWS[name])
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def duck(*names: str) -> str:
    """``with`` clause for DuckDB that defines the views and those below them."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for below in VIEWS:
                if "{" + below + "}" in VIEWS[name]:
                    need(below)
            order.append(name)

    for n in names:
        need(n)
    names_of = {t: t for t in (*TABLES, *VIEWS)}
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n].format(**names_of).replace('`', chr(34))})" for n in order)
