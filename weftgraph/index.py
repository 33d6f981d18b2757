"""Index repositories into a catalog: read, extract, load, link, stamp.

``index`` takes all repositories in one go. ``index_fleet`` works on groups of them at once, commits what is done
in the order of completion and halves a group that fails until the repository that fails stands alone.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .catalog import Catalog
from .fingerprints import FactStore
from .linking import LINKERS, relink, relink_changed  # noqa: F401  part of this module's surface
from .linking import edge_rows as _edges
from .operators import intervals, resolve
from .schema import OBJECTS
from .sources import deps, guidance, manifest, python_code, registry, scip
from .sources import files as files_
from .sources.staging import Staging

#: Binary code indexes among the files of a repository.
CODE_INDEX = r"\.scip$"
#: What a repository's own objects are.
OWN = ("service", "interface", "code_symbol")
#: Groups that are extracted at once, and groups per worker.
JOBS, GROUPS_PER_JOB = 4, 2


def _object(rows: DataFrame, kind: str, name, payload, summary=None) -> DataFrame:
    return rows.select(
        "id", F.lit(kind).alias("object_type"), "slug", name.alias("name"), (F.lit(None) if summary is None else summary).cast("string").alias("summary"), F.lit(None).cast("string").alias("version"), F.lit("static").alias("source"),
        F.lit("static").alias("generation_strategy"), F.current_timestamp().alias("last_generated_at"), F.to_json(payload).alias("payload"))


def _place(repo: str, path: str):
    """One path may stand in several repositories."""
    return F.concat_ws("#", repo, path)


def call_graph(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee, weight from the binary code indexes that stand among the files; none, no edge.

    A symbol means the same within one repository only.
    """
    seen = scip.read_occurrences(files.filter(F.col("path").rlike(CODE_INDEX))).filter(~F.col("symbol").startswith("local "))
    placed = seen.select(_place("repo", "symbol").alias("symbol"), _place("repo", "path").alias("path"), "line", "definition", F.struct("path", "pos").alias("pos"))
    return intervals.call_graph(placed.filter("not definition"), placed.filter("definition"), symbols.withColumn("path", _place("repo", "path")))


def written_rules(files: DataFrame) -> DataFrame:
    """Rules below the folders that manifests declare, with ``root`` (repository and folder); refused ones keep their row with ``error``."""
    roots = manifest.guidance_roots(files).withColumnRenamed("root", "_root")
    read = guidance.read_rules(files.filter(F.col("path").endswith(".md")))
    below = (F.col("_root") == "") | F.startswith("file", F.concat("_root", F.lit("/")))
    held = read.join(roots, "repo").filter(below).withColumn("root", F.concat_ws("/", "repo", F.when(F.col("_root") != "", F.col("_root")))).drop("_root")
    return held.dropDuplicates(["repo", "file"])


def extract(files: DataFrame, adapters: tuple = registry.ADAPTERS, kept: FactStore | None = None) -> dict[str, DataFrame]:
    """files(repo, path, content) -> the tables of what is found, all written: facts are read once, and what fails fails here.

    With ``kept`` facts only what changed since they were kept is parsed, by the readers of that store.

    interfaces, outbound, symbols, calls, bindings, identities, hosts, dependencies, languages, purpose, rules, shas and
    skipped (every site, file or rule that could not be read, with the reason).
    """
    staging = Staging(files.sparkSession, "extract")
    source = files.filter(~F.col("path").rlike(CODE_INDEX))
    read = registry.discover(source, adapters) if kept is None else kept.refresh(source)[0]
    facts = staging.save(registry.with_channels(read, source), "facts")
    values = staging.save(files_.config_values(source.filter(registry._is_config(F.col("path")) & ~F.col("path").endswith(".py"))), "values")
    found = {"repos": files.select(F.col("repo").alias("slug")).distinct(), "symbols": staging.save(python_code.symbol_spans(facts), "symbols")}
    found |= {"interfaces": registry.interfaces(facts), "outbound": python_code.outbound_calls(facts), "bindings": files_.host_bindings(values), "identities": files_.identities(values)}
    found |= {"hosts": manifest.declared_hosts(source), "calls": call_graph(files, found["symbols"]), "dependencies": deps.declared(source), "rules": written_rules(source)}
    found["languages"] = manifest.primary_language(source).join(deps.languages(source), "repo", "left")
    found["purpose"] = manifest.declared_purpose(source)
    found["shas"] = source.select("repo", "path", F.substring(F.sha1("content"), 1, 12).alias("file_sha"))
    found = {k: t if k == "symbols" else staging.save(t, k) for k, t in found.items()}
    refused = found["rules"].filter("error is not null").select(F.col("repo").alias("slug"), "file", F.lit(0).alias("line"), F.lit("refused-rule").alias("reason"), F.col("error").alias("expr"))
    dead = python_code.skipped_sites(facts).unionByName(registry.duplicate_paths(facts), allowMissingColumns=True).unionByName(refused, allowMissingColumns=True)
    return found | {"skipped": staging.save(dead, "skipped")}


def _gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Per slug the rows' columns as one sorted array."""
    return rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*columns) if len(columns) > 1 else columns[0])).alias(name))


def _services(found: dict[str, DataFrame]) -> DataFrame:
    slugged = lambda name: found[name].withColumnRenamed("repo", "slug")
    counts = found["interfaces"].groupBy("slug").agg(F.count(F.lit(1)).alias("interface_count")).join(slugged("symbols").groupBy("slug").agg(F.count(F.lit(1)).alias("symbol_count")), "slug", "full_outer")
    sites = found["skipped"].select("slug", "file", "line", "reason", "expr", F.when(F.col("name").isNotNull(), F.array("name")).alias("names"), "method")
    hosts = _gathered(found["hosts"], "_h", "pos", "pattern", "target").select("slug", F.map_from_entries(F.transform("_h", lambda h: F.struct(h["pattern"], h["target"]))).alias("declared_hosts"))
    out = found["repos"]
    for more in (
        counts, _gathered(found["outbound"], "outbound", "verb", "path", "host", "evidence"), _gathered(found["bindings"], "host_bindings", "key", "host", "port", "value", "file"),
        found["identities"].select("slug", F.struct("port", "name").alias("identity")), hosts, _gathered(slugged("dependencies"), "dependencies", "dependency"), slugged("languages"),
        _gathered(sites, "skipped", "file", "line", "reason", "expr", "names", "method"), slugged("purpose").select("slug", F.col("lines").alias("purpose")),
    ):
        out = out.join(more, "slug", "left")
    fields = (F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce("interface_count", F.lit(0)).alias("interface_count"), "outbound", "host_bindings", "identity", "declared_hosts", "dependencies", "languages", "language", "skipped", "purpose")
    return _object(out.withColumn("id", F.concat(F.lit("service:"), "slug")), "service", F.col("slug"), F.struct(*fields))


def _rules(found: dict[str, DataFrame]) -> DataFrame:
    """Rules as objects; of rules with one id that of the first file."""
    sound = found["rules"].filter("error is null").groupBy("id").agg(F.min_by(F.struct("repo", "title", "status", "scope", "dependencies", "languages", "reviewed", "owner", "file", "root", "content_hash", "body"), F.struct("repo", "file")).alias("r"))
    rows = sound.select(F.concat(F.lit("guidance:"), "id").alias("id"), F.col("r.repo").alias("slug"), "r.*")
    applies = F.struct("dependencies", "languages").alias("applies_to")
    payload = F.struct("status", "scope", applies, F.when(F.col("reviewed").rlike(r"^\d"), F.col("reviewed")).alias("reviewed"), "owner", "file", "root", "content_hash")
    return _object(rows, "guidance", F.col("title"), payload, F.col("body"))


def load(catalog: Catalog, found: dict[str, DataFrame]) -> int:
    """Replace what the catalog holds of the extracted repositories, in one commit; the number of them."""
    repos = found["repos"]
    service, rule = _services(found), _rules(found)
    interface = _object(found["interfaces"], "interface", F.concat_ws(" ", "method", "path"), F.struct("type", "method", "path", "handler", "framework", "evidence"))
    spans = found["symbols"].join(found["shas"], ["repo", "path"], "left").withColumn("slug", F.col("repo")).withColumn("qualname", F.substring_index("id", "::", -1))
    symbol = _object(spans, "code_symbol", F.col("qualname"), F.struct("path", "qualname", "kind", F.col("start").alias("line_start"), F.col("end").alias("line_end"), "file_sha"))
    at = found["interfaces"].select("id", F.transform("evidence", lambda e: F.concat(F.col("slug"), F.lit("#"), e)).alias("evidence"))
    handled = _edges(intervals.handler_edges(at, found["symbols"].withColumn("path", _place("repo", "path"))), "handled_by", "static")
    calls = _edges(found["calls"].select(F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), "weight"), "calls", "static")

    objects, edges = catalog.table("objects"), catalog.table("edges")
    own = objects.filter(F.col("object_type").isin(*OWN)).join(repos, "slug", "left_semi").select("id")
    # A rule goes if its file is not read again although its repository was; one that moved here from elsewhere is replaced.
    ruled = objects.filter("object_type = 'guidance'").join(repos, "slug", "left_semi").select("id").unionByName(rule.select("id"))
    gone = own.unionByName(ruled).distinct()
    names = [f.split(" ")[0] for f in OBJECTS.split(", ")]
    staging = Staging(catalog.spark, "index")
    every = objects.join(gone, "id", "left_anti").select(*names)
    for more in (service, interface, symbol, rule):
        every = every.unionByName(more.select(*names))
    every = staging.save(every, "objects")
    old = edges.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti").select(*edges.columns)
    catalog.commit(objects=every, edges=staging.save(resolve.valid_edges(old.unionByName(handled).unionByName(calls), every).select(*edges.columns), "edges"))
    return repos.count()


def _linked(catalog: Catalog) -> dict:
    """Link what the change reaches; if that fails, what is indexed stands with the old links, and the report says why."""
    try:
        linking.relink_changed(catalog)
        return {"relinked": True}
    except Exception as e:  # noqa: BLE001  best effort, reported
        return {"relinked": False, "link_error": f"{type(e).__name__}: {e}"[:500]}


def index(catalog: Catalog, files: DataFrame, shas: dict[str, str | None] | None = None, adapters: tuple = registry.ADAPTERS, kept: FactStore | None = None) -> dict:
    """Replace what the catalog holds of the repositories in ``files`` by what is in them now, link what that changes, stamp.

    ``kept``: see ``extract``. The report has services, skipped (sites that could not be read) and relinked, with link_error if it failed.
    """
    found = extract(files, adapters, kept)
    report = {"services": load(catalog, found), "skipped": found["skipped"].count()} | _linked(catalog)
    if shas:
        catalog.stamp(shas)
    return report


def index_fleet(catalog: Catalog, files: DataFrame, shas: dict[str, str | None] | None = None, adapters: tuple = registry.ADAPTERS, jobs: int = JOBS, groups: int | None = None,
                progress: Callable[[str, dict], None] | None = None) -> dict:
    """Index many repositories at once; one that cannot be read leaves the others indexed.

    Groups of repositories are extracted by ``jobs`` threads, whose Spark jobs share the cluster in a pool of
    their own; groups are committed one by one as they finish. A group that fails is halved and tried again, so
    k bad repositories of n cost about k log n tries, and one that fails alone is a dead letter in the report:
    ok, failed [(repository, error)], skipped, relinked. Only repositories that are indexed are stamped. The
    driver holds the names of the repositories. ``progress`` is told of each event as it happens.
    """
    spark, tell = catalog.spark, progress or (lambda event, about: None)
    names = sorted(r["repo"] for r in files.select("repo").distinct().collect())
    n = max(1, min(len(names), groups or jobs * GROUPS_PER_JOB))
    report: dict = {"ok": [], "failed": [], "skipped": 0}

    def work(group: list[str]) -> dict[str, DataFrame]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "index")
        return extract(files.filter(F.col("repo").isin(*group)), adapters)

    with ThreadPoolExecutor(max_workers=jobs) as pool:
        submit = lambda group: pool.submit(inheritable_thread_target(spark)(work), group)
        open_: dict[Future, list[str]] = {submit(group): group for group in (names[k::n] for k in range(n)) if group}
        while open_:
            for done in wait(open_, return_when=FIRST_COMPLETED).done:
                group = open_.pop(done)
                try:
                    found = done.result()
                    load(catalog, found)
                except Exception as e:  # noqa: BLE001  one repository must not end the sweep
                    if len(group) > 1:
                        tell("group-failed", {"repos": group, "error": str(e)[:500]})
                        for half in (group[::2], group[1::2]):
                            open_[submit(half)] = half
                    else:
                        report["failed"].append((group[0], f"{type(e).__name__}: {e}"[:500]))
                        tell("repo-failed", {"slug": group[0], "error": str(e)[:500]})
                    continue
                report["ok"] += group
                report["skipped"] += found["skipped"].count()
                tell("group-done", {"repos": group, "done": len(report["ok"]), "of": len(names)})
    report |= {"ok": sorted(report["ok"]), "failed": sorted(report["failed"])} | _linked(catalog)
    if shas:
        catalog.stamp({k: v for k, v in shas.items() if k in set(report["ok"])})
    return report


def governance(objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, services) for the questions about rules: service, rule, matched; id, dependencies, languages, language."""
    from .operators.answers import payload

    links = edges.filter("relationship = 'governed_by'").select(F.col("from_id").alias("service"), F.col("to_id").alias("rule"), "matched")
    return links, payload(objects, "service").select("id", "dependencies", "languages", "language")
