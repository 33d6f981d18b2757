"""Fleet-level joins: who calls whom, who publishes to whom, and how certain that is.

Inputs are flat tables: interfaces(slug, type, method, path, framework), outbound(slug, pos, verb, path, host),
bindings(slug, key, value, host, port), declared(slug, pos, pattern, target), services(slug, port, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ADDRESS_KEY, LOCAL_HOSTS, LOOPBACK, THIRD_PARTY, distinct_sorted, path_pattern, slug_tokens, slugish, strip_env_prefix
from ..sources.staging import Staging


def _dotted(hosts: DataFrame) -> DataFrame:
    """Of ``host`` values those that are dotted public names, with ``_n``, the name as slugs are written."""
    bare = F.regexp_replace(F.regexp_replace(F.lower("host"), "^.*@", ""), ":.*$", "")
    return hosts.select("host", bare.alias("_h")).filter(F.col("_h").contains(".") & ~F.col("_h").isin(*LOCAL_HOSTS)).withColumn("_n", slugish("_h"))


def hosts_naming(hosts: DataFrame, services: DataFrame) -> DataFrame:
    """Of distinct ``host`` values the dotted public names in which a service's slug occurs.

    A slug occurs in a name if it equals one of the name's substrings of its length, so names are cut to the
    lengths that slugs have and met by equality; no name is tried against every slug.
    """
    slugs = services.select(slugish("slug").alias("_s")).filter("_s <> ''").distinct()
    lengths = F.broadcast(slugs.select(F.length("_s").alias("_l")).distinct())  # as many rows as a slug has characters at most
    cut = _dotted(hosts).join(lengths, F.col("_l") <= F.length("_n")).select("host", F.explode(F.transform(F.sequence(F.lit(1), F.length("_n") - F.col("_l") + 1), lambda i: F.substr("_n", i, F.col("_l")))).alias("_s"))
    return cut.join(slugs, "_s", "left_semi").select("host").distinct()


def external_hosts(hosts: DataFrame, services: DataFrame) -> DataFrame:
    """Of distinct ``host`` values those that are dotted public names in which no service's slug occurs."""
    return _dotted(hosts).join(hosts_naming(hosts, services), "host", "left_anti").select("host")


def classify_calls(outbound: DataFrame, services: DataFrame) -> DataFrame:
    """Add ``pattern`` and ``status``: external first, then unspecific, else open."""
    foreign = external_hosts(outbound.select("host").filter("host <> ''").distinct(), services).withColumn("_x", F.lit(True))
    concrete = F.exists("pattern", lambda s: s.isNotNull())
    return outbound.join(foreign, "host", "left").withColumn("pattern", path_pattern("path")).withColumn(
        "status", F.when(F.col("_x"), "external").when(~concrete, "unspecific").otherwise("open")).drop("_x")


#: Marks in the key of a pattern; no segment holds a slash, so they cannot be taken for one.
WILD, TEMPLATED = "/*", "/?"


def _masks(offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns as (verb_, key, slugs) and, per (verb_, n), the masks that occur: which of the n segments are templates."""
    mask = F.array_join(F.transform("offer", lambda s: F.when(s.isNull(), "*").otherwise("=")), "")
    key = F.array_join(F.transform("offer", lambda s: F.coalesce(s, F.lit(WILD))), "/")
    patterns = offered.withColumns({"mask": mask, "key": key}).groupBy("verb_", "mask", "key").agg(F.collect_set("slug").alias("slugs"))
    return patterns, offered.groupBy("verb_", F.size("offer").alias("n")).agg(F.collect_set(mask).alias("masks"))


def _masked_keys(pattern: Column, masks: Column) -> Column:
    """The keys under which a call's segments can be offered: its literals where a mask has one, the mark elsewhere. A call's template meets templates only."""
    return F.transform(masks, lambda m: F.array_join(F.transform(pattern, lambda s, i: F.when(F.substr(m, i + 1, F.lit(1)) == "*", F.lit(WILD)).otherwise(F.coalesce(s, F.lit(TEMPLATED)))), "/"))


def _offered(interfaces: DataFrame) -> DataFrame:
    """Distinct (slug, verb_, offer): what each service answers, by segments."""
    rows = interfaces.filter(F.coalesce("type", F.lit("")) != "event")
    return rows.select("slug", F.upper(F.coalesce("method", F.lit(""))).alias("verb_"), "path").distinct().select("slug", "verb_", path_pattern("path").alias("offer"))


def _shapes(calls: DataFrame) -> DataFrame:
    """Distinct (verb_, path) of the calls with ``pattern``, its length ``n`` and whether any of it is ``concrete``."""
    return calls.select("verb_", "path").distinct().withColumn("pattern", path_pattern("path")).withColumns({"n": F.size("pattern"), "concrete": _concrete(F.col("pattern"))})


def _concrete(pattern: Column) -> Column:
    return F.exists(pattern, lambda s: s.isNotNull())


def _providers(calls: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Per distinct shape (verb_, path) of the calls: whether it is ``concrete`` and the services that offer it."""
    patterns, masks = _masks(_offered(interfaces))
    entered = _shapes(calls).join(masks, ["verb_", "n"], "left").select("verb_", "path", "concrete", F.explode_outer(F.when(F.col("concrete"), _masked_keys(F.col("pattern"), F.col("masks")))).alias("key"))
    found = entered.join(patterns.select("verb_", "key", "slugs"), ["verb_", "key"], "left")
    return found.groupBy("verb_", "path").agg(F.first("concrete").alias("concrete"), F.array_distinct(F.flatten(F.collect_list("slugs"))).alias("_providers"))


def _hash(value: Column) -> Column:
    return F.sha2(F.to_json(value), 256)


def _signed(calls: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Distinct shapes (verb_, path) that are offered, with the ``keys`` they are offered under and their hash ``sig``.

    Shapes of one ``sig`` have the same providers, so what holds for a provider is worked out per ``sig``.
    """
    offered = _offered(interfaces)
    _, masks = _masks(offered)
    entered = _shapes(calls).filter("concrete").join(masks, ["verb_", "n"]).select("verb_", "path", F.explode(_masked_keys(F.col("pattern"), F.col("masks"))).alias("key"))
    found = entered.join(_offers(offered).select("verb_", "key").distinct(), ["verb_", "key"]).groupBy("verb_", "path").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return found.withColumn("sig", _hash(F.struct("verb_", "keys")))


def _offers(offered: DataFrame) -> DataFrame:
    """(verb_, key, slug): who offers what, by the key that a call is entered under."""
    return offered.select("verb_", F.array_join(F.transform("offer", lambda s: F.coalesce(s, F.lit(WILD))), "/").alias("key"), "slug").distinct()


def callers_of(outbound: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Services (slug) with a call whose shape one of the interfaces offers, whatever its host."""
    calls = outbound.select("slug", "path", F.upper(F.coalesce("verb", F.lit(""))).alias("verb_"))
    return calls.join(_signed(calls, interfaces).select("verb_", "path"), ["verb_", "path"], "left_semi").select("slug").distinct()


#: External hosts, and providers, up to which they are broadcast to the calls.
MAX_HOSTS, MAX_PROVIDERS = 20_000, 1_000_000


def _open_calls(outbound: DataFrame, services: DataFrame, staging: Staging) -> DataFrame:
    """The calls, written once, with ``verb_`` and ``state``: external, unspecific or open.

    Only dotted hosts can be external; calls without one are never dealt out by their host.
    """
    calls = staging.save(outbound.select("slug", "pos", "path", "host", F.upper(F.coalesce("verb", F.lit(""))).alias("verb_")), "calls")
    dotted = F.coalesce(F.contains("host", F.lit(".")), F.lit(False))
    foreign = staging.save(external_hosts(calls.filter(dotted).select("host").distinct(), services), "foreign").withColumn("_x", F.lit(True))
    if foreign.count() <= MAX_HOSTS:
        rows = calls.join(F.broadcast(foreign), "host", "left")
    else:
        rows = calls.filter(dotted).join(foreign, "host", "left").unionByName(calls.filter(~dotted).withColumn("_x", F.lit(None).cast("boolean")))
    return rows.withColumn("state", F.when(F.col("_x"), "external").when(~_concrete(path_pattern("path")), "unspecific").otherwise("open")).drop("_x")


def _members(signed: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Distinct (sig, provider)."""
    keys = signed.select("sig", "verb_", "keys").distinct().select("sig", "verb_", F.explode("keys").alias("key"))
    return keys.join(_offers(_offered(interfaces)), ["verb_", "key"]).select("sig", F.col("slug").alias("provider")).distinct()


def count_calls(outbound: DataFrame, interfaces: DataFrame, services: DataFrame) -> DataFrame:
    """status, calls: ``resolve_counters(match_calls(...))``, no call being entered once per provider.

    A call is resolved if its shape has a provider other than its own service, which the least and the greatest
    of them tell; ``pos`` is not read.
    """
    staging = Staging(outbound.sparkSession, "counted")
    calls = _open_calls(outbound.withColumn("pos", F.lit(0)), services, staging).drop("pos", "host")
    signed = staging.save(_signed(calls, interfaces), "signed")
    ends = _members(signed, interfaces).groupBy("sig").agg(F.min("provider").alias("_least"), F.max("provider").alias("_most"))
    shapes = signed.join(ends, "sig").select("verb_", "path", "_least", "_most")
    other = (F.col("_least") != F.col("slug")) | (F.col("_most") != F.col("slug"))
    closed = calls.filter("state <> 'open'").groupBy(F.col("state").alias("status")).agg(F.count(F.lit(1)).alias("calls"))
    looked = calls.filter("state = 'open'").select("slug", "verb_", "path").join(shapes, ["verb_", "path"], "left")
    return closed.unionByName(looked.groupBy(F.when(other, "resolved").otherwise("unresolved").alias("status")).agg(F.count(F.lit(1)).alias("calls")))


#: Providers of a class that are entered as one row, and pairs of one task.
CHUNK, PAIRS = 4096, 2_000_000


def _naming(hosts: DataFrame, providers: DataFrame) -> DataFrame:
    """(host, provider) where the host's name holds the provider's: names are cut to the lengths that providers have and met by equality."""
    slugs = providers.select("provider", F.regexp_replace("provider", "_", "-").alias("_s"))
    lengths = F.broadcast(slugs.select(F.length("_s").alias("_l")).distinct())
    hint = hosts.select("host", F.regexp_replace("host", "_", "-").alias("_h")).filter("_h <> ''").join(lengths, F.col("_l") <= F.length("_h"))
    cut = hint.select("host", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_h") - F.col("_l") + 1), lambda i: F.substr("_h", i, F.col("_l"))))).alias("_s"))
    return cut.join(slugs, "_s").select("host", "provider")


def call_groups(outbound: DataFrame, interfaces: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by class: groups (slug, cls, first, via_paths, named) and classes (provider, cls), both written.

    Calls are aggregated per service and set of keys (``sig``) that offer their shape; providers that offer the same
    sets are one class, so edges are worked out per service and class, and a provider is of one class. What a host
    adds holds for the few providers that it names and is kept beside the class.
    """
    staging = Staging(outbound.sparkSession, "linked")
    calls = _open_calls(outbound, services, staging).filter("state = 'open'")
    signed = staging.save(_signed(calls, interfaces), "signed")
    met = staging.save(calls.join(signed.select("verb_", "path", "sig"), ["verb_", "path"]).select("slug", "sig", "pos", "path", "host"), "met")
    members = staging.save(_members(signed, interfaces), "members")
    classes = staging.save(members.groupBy("provider").agg(_hash(F.array_sort(F.collect_set("sig"))).alias("cls")), "classes")
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"))
    own = members.select("sig", F.col("provider").alias("slug"), F.lit(1).alias("_own"))
    first = met.groupBy("slug", "sig").agg(F.min("pos").alias("pos")).join(sizes, "sig").join(own, ["sig", "slug"], "left")
    first = first.withColumn("first", F.when(F.col("_n") - F.coalesce("_own", F.lit(0)) == 1, "high").otherwise("ambiguous"))
    place = F.row_number().over(Window.partitionBy("slug", "sig").orderBy("path"))
    paths = met.select("slug", "sig", "path").distinct().withColumn("_k", place).filter("_k <= 10").groupBy("slug", "sig").agg(F.collect_list("path").alias("paths"))
    held = members.join(classes, "provider").select("sig", "cls").distinct()
    edges = first.join(paths, ["slug", "sig"]).join(held, "sig").groupBy("slug", "cls").agg(F.min_by("first", "pos").alias("first"), distinct_sorted(F.flatten(F.collect_list("paths")), 10).alias("via_paths"))
    said = met.filter("host <> ''").select("slug", "sig", "host").distinct()
    named = said.join(_naming(said.select("host").distinct(), classes), "host").join(members, ["sig", "provider"], "left_semi").select("slug", "provider").distinct()
    named = named.join(classes, "provider").groupBy("slug", "cls").agg(F.collect_list("provider").alias("named"))
    edges = staging.save(edges.join(named, ["slug", "cls"], "left"), "edges")
    return edges, classes


def group_edges(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """from_slug, to_slug, confidence, via_paths of all pairs: they come out of the classes' members at the end and are neither dealt out nor aggregated."""
    staging = Staging(groups.sparkSession, "paired")
    count = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("_size"))
    chunk = F.pmod(F.xxhash64("provider"), F.ceil(F.col("_size") / CHUNK))
    chunks = staging.save(classes.join(count, "cls").groupBy("cls", chunk.alias("_chunk")).agg(F.collect_list("provider").alias("providers")), "chunks").drop("_chunk")
    pairs = groups.join(count, "cls").agg(F.sum("_size")).first()[0] or 0
    edges = groups.repartition(max(1, -(-pairs // PAIRS)), "slug", "cls")
    met = edges.join(F.broadcast(chunks) if classes.count() <= MAX_PROVIDERS else chunks, "cls")
    one = lambda confidence: lambda p: F.struct(p.alias("to_slug"), confidence.alias("confidence"))
    raised = F.array_intersect("providers", "named")
    ends = F.when(F.col("named").isNull(), F.transform("providers", one(F.col("first")))).otherwise(F.concat(F.transform(raised, one(F.lit("corroborated"))), F.transform(F.array_except("providers", "named"), one(F.col("first")))))
    return met.select(F.col("slug").alias("from_slug"), F.explode(ends).alias("_e"), "via_paths").select("from_slug", "_e.to_slug", "_e.confidence", "via_paths").filter("to_slug <> from_slug")


def linked_calls(outbound: DataFrame, interfaces: DataFrame, services: DataFrame) -> DataFrame:
    """from_slug, to_slug, confidence, via_paths: ``call_edges(match_calls(...))``, no call being entered once per provider."""
    return group_edges(*call_groups(outbound, interfaces, services))


def edges_apart(groups: DataFrame, classes: DataFrame, declared: DataFrame) -> DataFrame:
    """from_slug, to_slug, confidence, via_paths and cls of those pairs of the groups that say something of their own: a host names the provider, or configuration declares the pair."""
    named = groups.filter("named is not null").select("slug", "cls", "via_paths", F.explode("named").alias("provider"), F.lit("corroborated").alias("confidence"))
    pairs = declared.select(F.col("from_slug").alias("slug"), F.col("to_slug").alias("provider")).distinct()
    confidence = F.when(F.coalesce(F.array_contains("named", F.col("provider")), F.lit(False)), "corroborated").otherwise(F.col("first"))
    said = pairs.join(classes, "provider").join(groups, ["slug", "cls"]).select("slug", "cls", "via_paths", "provider", confidence.alias("confidence"))
    rows = named.unionByName(said).filter("slug <> provider").dropDuplicates(["slug", "provider"])
    return rows.select(F.col("slug").alias("from_slug"), F.col("provider").alias("to_slug"), "confidence", "via_paths", "cls")


def match_calls(outbound: DataFrame, interfaces: DataFrame, services: DataFrame) -> DataFrame:
    """Calls with ``provider`` (null: unresolved) and ``n_providers``; external and unspecific calls keep their status.

    Shapes (verb, path) meet patterns, not calls interfaces, and they meet by equality alone: a shape is entered
    once per mask that patterns of its verb and length have, with the mask's literals as the key, so none is
    tried against a pattern that it does not match. The providers of a shape are gathered once, as an array;
    calls take them by equality and drop their own, in one pass.
    """
    calls = outbound.withColumn("verb_", F.upper(F.coalesce("verb", F.lit(""))))
    known = _providers(calls, interfaces)
    foreign = external_hosts(outbound.select("host").filter("host <> ''").distinct(), services).withColumn("_x", F.lit(True))
    met = calls.join(foreign, "host", "left").join(known, ["verb_", "path"], "left")
    open_ = F.col("_x").isNull() & F.coalesce("concrete", F.lit(False))  # in this order: external, unspecific, else looked at
    own = F.when(open_, F.filter(F.coalesce("_providers", F.array().cast("array<string>")), lambda p: p != F.col("slug")))
    n = F.coalesce(F.size("_own"), F.lit(0))
    status = F.when(F.col("_x"), "external").when(F.col("_own").isNull(), "unspecific").when(n > 0, "resolved").otherwise("unresolved")
    rows = met.withColumn("_own", own).withColumns({"status": status, "n_providers": F.when(F.col("_own").isNotNull(), n).otherwise(0).cast("long")})
    return rows.select("slug", "pos", "verb", "path", "host", "status", F.explode_outer("_own").alias("provider"), "n_providers")


def call_edges(matched: DataFrame) -> DataFrame:
    """from_slug, to_slug, confidence, via_paths: the first call's confidence, raised by any host that names the provider."""
    hint = F.regexp_replace(F.coalesce("host", F.lit("")), "_", "-")
    slug = F.regexp_replace("provider", "_", "-")
    named = (hint != "") & hint.contains(slug)
    first = F.when(F.col("n_providers") == 1, "high").otherwise("ambiguous")
    return matched.filter("provider is not null").groupBy(F.col("slug").alias("from_slug"), F.col("provider").alias("to_slug")).agg(
        F.min_by(first, F.col("pos")).alias("first"), F.bool_or(named).alias("named"), distinct_sorted(F.collect_set("path"), 10).alias("via_paths"),
    ).select("from_slug", "to_slug", F.when(F.col("named"), "corroborated").otherwise(F.col("first")).alias("confidence"), "via_paths")


def resolve_counters(matched: DataFrame) -> DataFrame:
    calls = matched.select("slug", "pos", "status").distinct()
    return calls.groupBy("status").agg(F.count(F.lit(1)).alias("calls"))


# Addresses in configuration: an ordered chain of rules, the first hit wins.

def _slug_match(rows: DataFrame, services: DataFrame, tokens: Column, name: str) -> DataFrame:
    """Longest slug whose tokens lead ``tokens``: rows (``_id``, name). Joined on the first token, so no pair is tried in vain."""
    at = rows.select("_id", tokens.alias("_t")).filter(F.size("_t") > 0).withColumn("_first", F.try_element_at("_t", F.lit(1)))
    slugs = services.select("slug", slug_tokens("slug").alias("_p"), F.length(slugish("slug")).alias("_len")).filter(F.size("_p") > 0).withColumn("_first", F.try_element_at("_p", F.lit(1)))
    hit = at.join(slugs, "_first").filter(F.slice("_t", 1, F.size("_p")) == F.col("_p"))
    return hit.groupBy("_id").agg(F.min_by("slug", F.struct(-F.col("_len"), F.col("slug"))).alias(name))


def _glob(pattern: Column) -> Column:
    """A pattern in which only ``*`` is special, as a whole-match regular expression."""
    quoted = F.regexp_replace(pattern, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def _by_declaration(rows: DataFrame, services: DataFrame, declared: DataFrame) -> DataFrame:
    return rows.join(declared.select("slug", F.col("pattern").alias("host"), F.col("target").alias("t")), ["slug", "host"]).groupBy("_id").agg(F.min("t").alias("t"))


def _by_pattern(rows: DataFrame, services: DataFrame, declared: DataFrame) -> DataFrame:
    stars = declared.filter(F.col("pattern").contains("*")).select("slug", "pos", _glob(F.col("pattern")).alias("_g"), "target")
    return rows.join(stars, "slug").filter(F.expr("host rlike _g")).groupBy("_id").agg(F.min_by("target", "pos").alias("t"))


def _by_cluster_name(rows: DataFrame, services: DataFrame, declared: DataFrame) -> DataFrame:
    inside = rows.filter(F.col("host").contains(".svc") | F.col("host").endswith(".cluster.local"))
    return _slug_match(inside, services, slug_tokens(F.element_at(F.split("host", r"\."), 1)), "t")


def _by_host_name(rows: DataFrame, services: DataFrame, declared: DataFrame) -> DataFrame:
    return _slug_match(rows.filter(~F.col("host").rlike(THIRD_PARTY)), services, slug_tokens("host"), "t")


def _by_port(rows: DataFrame, services: DataFrame, declared: DataFrame) -> DataFrame:
    ports = services.filter("port <> ''").groupBy("port").agg(F.min("slug").alias("t"))
    return rows.filter(F.col("host").isin(*LOOPBACK) & (F.col("port") != "")).select("_id", "port").join(ports, "port").select("_id", "t")


def _by_key(rows: DataFrame, services: DataFrame, declared: DataFrame) -> DataFrame:
    """The innermost segment of the key that names a service, by the name it gives itself or by its slug."""
    aliases = services.filter("name <> ''").groupBy(slugish("name").alias("_a")).agg(F.min("slug").alias("_by_alias"))
    segments = rows.filter((F.col("host") == "") | F.col("host").isin(*LOOPBACK)).select("_id", F.posexplode(F.reverse(F.split("key", r"\."))).alias("_at", "_seg"))
    segments = segments.withColumn("_token", F.regexp_replace("_seg", ADDRESS_KEY, "")).filter("_token <> ''").withColumn("_row", F.col("_id")).withColumn("_id", F.concat_ws(":", "_row", "_at"))
    by_key = segments.withColumn("_a", slugish("_token")).join(aliases, "_a", "left").join(_slug_match(segments, services, slug_tokens("_token"), "_by_slug"), "_id", "left")
    return by_key.withColumn("_t", F.coalesce("_by_alias", "_by_slug")).filter("_t is not null").groupBy(F.col("_row").alias("_id")).agg(F.min_by("_t", "_at").alias("t"))


#: The chain of rules: name, and (rows with ``_id``, services, declared) -> (_id, t). A longer or other list may be passed.
HOST_RULES = (("exact", _by_declaration), ("glob", _by_pattern), ("k8s", _by_cluster_name), ("slug", _by_host_name), ("port", _by_port), ("key", _by_key))


def resolve_hosts(bindings: DataFrame, services: DataFrame, declared: DataFrame, rules: tuple = HOST_RULES) -> DataFrame:
    """bindings + ``target`` and ``rule`` (the first of the chain that hits); unresolved and self targets are left out.

    A rule sees distinct (slug, key, host, port), told apart by a hash of the four: equal bindings resolve alike,
    and no branch depends on how another was planned.
    """
    parts = ["slug", "key", "host", "port"]
    staging = Staging(bindings.sparkSession, "hosts")  # six rules read the same rows: bindings are taken apart once
    named = bindings.withColumn("_id", F.sha2(F.to_json(F.struct(*parts)), 256))
    named = staging.save(named, "named")
    rows = named.select("_id", "slug", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("port", F.lit("")).alias("port")).dropDuplicates(["_id"])
    rows = staging.save(rows, "rows")
    out = named
    for k, (_, find) in enumerate(rules):
        out = out.join(find(rows, services, declared).withColumnRenamed("t", f"t{k}"), "_id", "left")
    rule = F.coalesce(*(F.when(F.col(f"t{k}").isNotNull(), F.lit(name)) for k, (name, _) in enumerate(rules)))
    return out.withColumn("target", F.coalesce(*(f"t{k}" for k in range(len(rules))))).withColumn("rule", rule).filter("target is not null and target <> slug").select(*bindings.columns, "target", "rule")


def declared_edges(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(F.col("slug").alias("from_slug"), F.col("target").alias("to_slug")).agg(
        distinct_sorted(F.collect_set("key"), 10).alias("via_config_keys"), distinct_sorted(F.collect_set("host"), 5).alias("via_hosts"))


#: Declared edges that are broadcast to the observed ones.
MAX_DECLARED = 20_000


def merge_declared(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed edges, raised where configuration says the same; declared edges that nothing showed.

    Up to ``MAX_DECLARED`` declared edges are broadcast: the observed ones, which may be as many as pairs, stay where they are.
    """
    keys, columns = ["from_slug", "to_slug"], ("via_config_keys", "via_hosts")
    declared = Staging(declared.sparkSession, "declared").save(declared.select(*keys, *columns), "edges")
    if declared.count() <= MAX_DECLARED:
        met = observed.select(*keys).join(F.broadcast(declared.select(*keys)), keys, "left_semi").distinct()
        new = declared.join(met, keys, "left_anti").select(*keys, *(F.lit(None).cast(observed.schema[c].dataType).alias(c) for c in ("confidence", "via_paths")), *columns)
        both = observed.join(F.broadcast(declared), keys, "left").select(*keys, "confidence", "via_paths", *columns).unionByName(new)
    else:
        both = observed.join(declared, keys, "full_outer")
    seen, said = F.col("confidence").isNotNull(), F.col("via_config_keys").isNotNull()
    raised = seen & said & F.col("confidence").isin("high", "ambiguous")
    return both.select(
        "from_slug", "to_slug", F.when(~seen, "config").when(raised, "corroborated").otherwise(F.col("confidence")).alias("confidence"), "via_paths",
        F.when(raised | ~seen, F.col("via_hosts")).alias("via_hosts"), F.when(~seen, F.col("via_config_keys")).alias("via_config_keys"))


# Channels.

def channel_ends(interfaces: DataFrame) -> DataFrame:
    return interfaces.filter("type = 'event'").select("slug", strip_env_prefix("path").alias("channel"), F.upper("method").alias("direction"), F.coalesce("framework", F.lit("")).alias("framework"))


#: Ends per side of a channel from which its pairs are made in cells of so many by so many.
CELL = 256


def _cells(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``channel`` with ``_i`` and ``_j``: a light channel is one cell, a heavy one a grid.

    The sides of a heavy channel are cut into slices by a hash of the service; every row of a slice is entered
    once per slice of the other side, so a task makes the pairs of cells and never those of a whole channel.
    The number of slices comes from the counted ends; rows entered are at most ends times slices.
    """
    count = lambda side, name: side.groupBy("channel").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))
    grid = count(left, "_rows").join(count(right, "_columns"), "channel")
    slice_of = lambda n: F.pmod(F.xxhash64("slug"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(grid, "channel").withColumn("_i", slice_of("_rows")).withColumn("_j", every("_columns")).drop("_rows", "_columns")
    b = right.join(grid, "channel").withColumn("_j", slice_of("_columns")).withColumn("_i", every("_rows")).drop("_rows", "_columns")
    return a, b


def publish_edges(ends: DataFrame) -> DataFrame:
    """Each publisher of a channel with each consumer or end of unknown direction; ends are made distinct first."""
    distinct = ends.groupBy("slug", "channel", "direction").agg(F.bool_or(F.col("framework") == "config").alias("config"))
    pubs = distinct.filter("direction = 'PUBLISH'").select("channel", "slug", F.col("config").alias("_p"))
    cons = distinct.filter("direction in ('CONSUME', 'USES')").groupBy("channel", "slug").agg(F.bool_or("config").alias("_c"))
    a, b = _cells(pubs, cons)
    met = a.withColumnRenamed("slug", "from_slug").join(b.withColumnRenamed("slug", "to_slug"), ["channel", "_i", "_j"])
    return met.filter("from_slug <> to_slug").groupBy("from_slug", "to_slug").agg(
        distinct_sorted(F.collect_set("channel"), 20).alias("channels"),
        F.when(F.bool_or(F.col("_p") | F.col("_c")), "config").otherwise("static").alias("confidence"))


def shared_edges(ends: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Unordered pairs that meet on a channel nobody is known to publish; only those that start at ``sources`` (slug) if given."""
    pubs = ends.filter("direction = 'PUBLISH'").select("channel").distinct()
    open_ = ends.filter("direction in ('CONSUME', 'USES')").select("channel", "slug").distinct().join(pubs, "channel", "left_anti")
    a, b = _cells(open_ if sources is None else open_.join(sources.select("slug"), "slug", "left_semi").select("channel", "slug"), open_)
    met = a.withColumnRenamed("slug", "from_slug").join(b.withColumnRenamed("slug", "to_slug"), ["channel", "_i", "_j"])
    return met.filter("from_slug < to_slug").groupBy("from_slug", "to_slug").agg(distinct_sorted(F.collect_set("channel"), 20).alias("channels")).withColumn("confidence", F.lit("direction-unknown"))


def valid_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both ends of which are known (``id``)."""
    known = ids.select("id")
    return edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order, by an aggregate that is combined before the exchange."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*order)).alias("_first"))
    return first.select("_first.*")
