"""Lines and spans: which symbol encloses a line, what a piece of evidence touches, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_evidence
from ..sources.staging import Staging


#: Lines of a leaf of the tree are 2 ** LEAF: most spans are one or two tiles then.
LEAF = 6


def _shift(value, bits) -> Column:
    return F.call_function("shiftright", value, bits)


def cover(start: Column, end: Column) -> Column:
    """The nodes (level, at) of a binary tree that tile leaves ``start`` to ``end``: at most two per level.

    A node of level k holds 2 ** k leaves. At each level the tiles are the node left over on either side, which
    the bounds of that level, rounded inwards, tell; an interval of n leaves has at most 2 log2 n tiles.
    """
    start, past = start.cast("long"), end.cast("long") + 1
    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(past - start, F.lit(1)))) - 1)
    low = lambda k: -_shift(-start, k)  # noqa: E731  rounded up
    high = lambda k: _shift(past, k)
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
    node = lambda k, at: F.struct(k.cast("int").alias("level"), at.alias("at"))
    some = lambda k: low(k) < high(k)
    tiles = F.flatten(F.transform(levels, lambda k: F.array(F.when(some(k) & odd(low(k)), node(k, low(k))), F.when(some(k) & odd(high(k)), node(k, high(k) - 1)))))
    return F.filter(tiles, lambda n: n.isNotNull())


def _tiles(spans: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """The spans under the nodes (_level, _at) that tile their leaves, and the levels that occur, by path."""
    tiles = spans.withColumn("_n", F.explode(cover(_shift(F.col(start), F.lit(LEAF)), _shift(F.col(end), F.lit(LEAF))))).select(*spans.columns, F.col("_n.level").alias("_level"), F.col("_n.at").alias("_at"))
    return tiles, tiles.groupBy("path").agg(F.collect_set("_level").alias("_levels"))


def stab(points: DataFrame, spans: DataFrame, line: str, start: str, end: str) -> DataFrame:
    """points(path, line, ...) joined with every span(path, start, end, ...) around them: an equi-join, each pair once.

    A span is entered under the tiles that cover its leaves, a point under its leaf's ancestors of those levels
    that the spans of its path have. Exactly one ancestor of a point inside a span is a tile of it, so no pair
    comes twice, and only those of a span's first and last leaf are tried in vain. Rows grow with the logarithm
    of a span's lines.
    """
    tiles, levels = _tiles(spans, start, end)
    up = points.join(levels, "path").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_at", _shift(F.col(line).cast("long"), F.col("_level") + LEAF))
    return up.join(tiles, ["path", "_level", "_at"]).filter((F.col(start) <= F.col(line)) & (F.col(line) <= F.col(end))).drop("_level", "_at")


#: Kinds of symbols that call, are called and handle requests.
CALLABLE = ("function", "method")


def callable_spans(spans: DataFrame) -> DataFrame:
    """Spans of functions and methods; spans without a kind are taken as they are."""
    return spans.filter(F.col("kind").isin(*CALLABLE)) if "kind" in spans.columns else spans


def tightest_span(points: DataFrame, spans: DataFrame, tie: str = "latest") -> DataFrame:
    """points(path, line, ...) with ``id`` of the smallest span(path, start, end, id) around them (null: none).

    Ties: ``latest`` start, then greatest id; or ``lowest`` id. The distinct lines of a leaf travel as one row, as in
    ``stab``, and part only where a span is met.
    """
    leaf = _shift(F.col("line").cast("long"), F.lit(LEAF)).alias("_leaf")
    lines = points.select("path", "line", leaf).filter("line is not null").groupBy("path", "_leaf").agg(F.collect_set("line").alias("_lines"))
    tiles, levels = _tiles(spans.select("path", "start", "end", "id"), "start", "end")
    up = lines.join(levels, "path").withColumn("_level", F.explode("_levels")).withColumn("_at", _shift(F.col("_leaf"), F.col("_level"))).select("path", "_lines", "_level", "_at")
    size = F.col("end") - F.col("start")
    inside = F.filter("_lines", lambda n: (F.col("start") <= n) & (n <= F.col("end")))
    met = up.join(tiles, ["path", "_level", "_at"]).select("path", F.explode(inside).alias("line"), "start", "end", "id")
    best = F.min(F.struct(size.alias("size"), "id")) if tie == "lowest" else F.max(F.struct((-size).alias("size"), "start", "id"))
    return points.join(met.groupBy("path", "line").agg(best.alias("_best")).select("path", "line", F.col("_best.id").alias("id")), ["path", "line"], "left")


def call_graph(references: DataFrame, definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """caller, callee, weight from references(symbol, path, line) and definitions(symbol, pos, path, line).

    A symbol's first definition counts; local symbols, recursion and sites outside every span are dropped, and
    so are symbols that are neither function nor method where spans say their kind.
    """
    spans = callable_spans(spans)
    named = ~F.col("symbol").startswith("local ")
    first = definitions.filter(named).groupBy("symbol").agg(F.min_by(F.struct("path", "line"), "pos").alias("d")).select("symbol", "d.path", "d.line")
    callee = tightest_span(first, spans).filter("id is not null").select("symbol", F.col("id").alias("callee"))
    caller = tightest_span(references.filter(named), spans).filter("id is not null").select("symbol", F.col("id").alias("caller"))
    return caller.join(callee, "symbol").filter("caller <> callee").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("weight"))


def handler_edges(interfaces: DataFrame, spans: DataFrame) -> DataFrame:
    """interface(id, evidence[]) -> distinct (from_id, to_id); evidence of whole files names no handler, nor does a span of another kind than function or method."""
    spans = callable_spans(spans)
    at = interfaces.select(F.col("id").alias("from_id"), F.explode("evidence").alias("e")).withColumn("p", parse_evidence("e")).filter("p.lo is not null")
    return tightest_span(at.select("from_id", F.col("p.path").alias("path"), F.col("p.lo").alias("line")), spans, "latest").filter("id is not null").select("from_id", F.col("id").alias("to_id")).distinct()


def evidence_symbols(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """evidence(ref, e) -> (ref, id) of every symbol it overlaps; a bare path overlaps all of its file.

    Two intervals overlap if the first line of either lies in the other: evidence that begins inside a span,
    and spans that begin inside evidence behind its first line. Both are looked up by line, no pair comes twice.
    """
    at = evidence.withColumn("p", parse_evidence("e")).filter("p is not null").select("ref", F.col("p.path").alias("path"), F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi")).distinct()
    at = Staging(evidence.sparkSession, "evidence").save(at, "at")  # parsed once, read by each side of both lookups
    lines, spans = at.filter("lo is not null"), spans.select("path", "start", "end", "id")
    inside = stab(lines, spans, "lo", "start", "end").filter("start <= hi").select("ref", "id")
    behind = stab(spans, lines.filter("lo < hi").withColumn("_lo", F.col("lo") + 1), "start", "_lo", "hi").select("ref", "id")
    whole = at.filter("lo is null").join(spans, "path").select("ref", "id")
    return inside.unionByName(behind).unionByName(whole).distinct()


def stale(refs: DataFrame, touched: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Whether what each ref was written from has changed: nothing resolved, gone, or another hash.

    refs(ref), touched(ref, id), old and new (id, hash).
    """
    o, n = old.select("id", F.col("hash").alias("_o")), new.select("id", F.col("hash").alias("_n"))
    state = touched.join(o, "id", "left").join(n, "id", "left").groupBy("ref").agg(F.bool_or(F.coalesce(F.col("_o") != F.col("_n"), F.lit(True))).alias("stale"))
    return refs.join(state, "ref", "left").withColumn("stale", F.coalesce("stale", F.lit(True)))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (added, removed, changed) between two indexes (id, hash)."""
    o, n = old.select("id", F.col("hash").alias("_o")), new.select("id", F.col("hash").alias("_n"))
    both = o.join(n, "id", "full_outer")
    change: Column = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return both.select("id", change.alias("change")).filter("change is not null")


def rails_handlers(interfaces: DataFrame, actions: DataFrame) -> DataFrame:
    """Append ``file:line`` of a handler ``controller#action``: by full name, else by bare name; first wins."""
    full = actions.filter("full").groupBy("name").agg(F.min_by("place", "pos").alias("_full"))
    bare = actions.filter("not full").groupBy("name").agg(F.min_by("place", "pos").alias("_bare"))
    tail = F.element_at(F.split("handler", "/"), -1)
    joined = interfaces.join(full, F.col("handler") == full["name"], "left").drop("name").withColumn("_tail", tail).join(bare, F.col("_tail") == bare["name"], "left").drop("name", "_tail")
    place = F.coalesce("_full", "_bare")
    return joined.withColumn("evidence", F.when(place.isNotNull(), F.array_append("evidence", place)).otherwise(F.col("evidence"))).drop("_full", "_bare")


def unique_tail(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """Import tails that exactly one known key is or ends in: (tail, key). Keys are cut to their dotted tails and met by equality."""
    steps = F.split("key", r"\.")
    tails = keys.select("key").distinct().withColumn("_s", steps).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("_s")), lambda i: F.array_join(F.slice("_s", i, F.size("_s")), "."))).alias("tail"))
    met = wanted.select("tail").distinct().join(tails, "tail")
    return met.groupBy("tail").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("key")).filter("_n = 1").drop("_n")


def symbols_only(spans: DataFrame) -> DataFrame:
    """Nodes of a call graph for languages without a code index: every symbol, no edge (id, path, qualname, kind, lang, line_start, line_end)."""
    lang = F.col("lang") if "lang" in spans.columns else F.lit("")
    return spans.select("id", "path", F.substring_index("id", "::", -1).alias("qualname"), F.coalesce("kind", F.lit("function")).alias("kind"), lang.alias("lang"), F.col("start").alias("line_start"), F.col("end").alias("line_end"))
