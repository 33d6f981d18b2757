"""Sites the readers could not resolve: what a model is shown of them, and what of its answers is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import content_hash
from ..shipping import ship
from .semantic import grounded

#: Symbols and lines of context shown with a site.
MAX_SYMBOLS, MAX_LINES, PAD = 4, 40, 6
#: Kinds that come first, for a name is mostly explained by its class.
CLASSES = ("class", "module")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
TASK = {
    "interface": "a route is registered under a path that is an expression",
    "outbound": "an HTTP call goes to an address that is an expression",
    "event": "a message is sent or received on a channel that is an expression",
}
REPLY = {
    "event": '{"resolved": true, "direction": "PUBLISH or CONSUME", "channel": "name"} or {"resolved": false, "reason": "where the value comes from"}',
    "": '{"resolved": true, "method": "VERB", "path": "/path", "host": "host or null"} or {"resolved": false, "reason": "where the value comes from"}',
}


def lines_of(text: Column, start: Column, end: Column, most: int = MAX_LINES) -> Column:
    """Lines ``start`` to ``end`` of a text, no more than ``most``."""
    low = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n"), low, F.greatest(F.least(end - low + 1, F.lit(most)), F.lit(0))), "\n")


def identifier_symbols(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(gap, symbol columns, rank) of up to four symbols of the site's own service whose last name an identifier is.

    sites(gap, slug, names[]), symbols(slug, id, path, qualname, kind, line_start, line_end). Names shorter than
    three letters say nothing. Classes and modules come first, then the order of the names.
    """
    asked = sites.select("gap", "slug", F.posexplode("names").alias("pos", "leaf")).filter(F.length("leaf") >= 3)
    named = symbols.withColumn("leaf", F.element_at(F.split("qualname", r"\."), -1))
    met = asked.join(named, ["slug", "leaf"]).groupBy("gap", "slug", "id", "path", "qualname", "kind", "line_start", "line_end").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("gap").orderBy(~F.col("kind").isin(*CLASSES), "pos", "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_SYMBOLS)


def textual_definitions(sites: DataFrame, texts: DataFrame) -> DataFrame:
    """(gap, path, line, block, rank): lines that define an identifier, for sites without a symbol; texts(slug, path, text)."""
    asked = sites.select("gap", "slug", F.explode("names").alias("name")).filter(F.length("name") >= 3).distinct()
    lines = texts.select("slug", "path", "text", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    head = r"^\s*(?:export\s+)?(?:(?:const|let|var|def|class|val|static\s+final\s+\w+)\s+)?(\w+)\s*[=:(]"
    defined = lines.withColumn("name", F.regexp_extract("line", head, 1)).filter(F.length("name") >= 3)
    met = defined.join(asked, ["slug", "name"]).select("gap", "path", (F.col("at") + 1).alias("line"), lines_of(F.col("text"), F.col("at") + 1, F.col("at") + 1 + PAD).alias("block")).distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("gap").orderBy("path", "line"))).filter(F.col("rank") <= MAX_SYMBOLS)


def gap_context(sites: DataFrame, symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(gap, context): the definitions behind a site's identifiers, by symbol, else textually; texts(slug, path, text)."""
    picked = identifier_symbols(sites, symbols).join(texts, ["slug", "path"])
    source = lines_of(F.col("text"), F.col("line_start"), F.col("line_end"))
    by_symbol = picked.select("gap", "rank", F.concat(F.lit("# "), "path", F.lit(":"), F.col("line_start").cast("string"), F.lit(" ("), "kind", F.lit(" "), "qualname", F.lit(")\n"), source).alias("block"))
    rest = sites.join(by_symbol.select("gap").distinct(), "gap", "left_anti")
    by_text = textual_definitions(rest, texts).select("gap", "rank", F.concat(F.lit("# "), "path", F.lit(":"), F.col("line").cast("string"), F.lit("\n"), "block").alias("block"))
    blocks = by_symbol.unionByName(by_text).groupBy("gap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    return sites.select("gap").join(blocks, "gap", "left").withColumn("context", F.coalesce("context", F.lit("")))


def gap_prompt(kind: str = "kind", context: str = "context") -> Column:
    """The question put to a model about one site (kind, file, line, expr, method, snippet)."""
    say = lambda made: F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in made.items() if k), F.lit(made.get("", "")))
    known = F.when(F.col("method").isNotNull(), F.concat(F.lit("\nAlready known: "), "method")).otherwise("")
    return F.concat(
        F.lit("In the code below "), say(TASK), F.lit(". Follow it through the definitions to its literal value. A value that comes from configuration, the environment or code not shown is not resolved.\nSite: "),
        "file", F.lit(":"), F.col("line").cast("string"), F.lit("\nExpression: "), F.coalesce("expr", F.lit("")), known, F.lit("\n\nCode:\n"), F.coalesce("snippet", F.lit("")),
        F.lit("\n\nDefinitions:\n"), F.when(F.col(context) == "", "(none found)").otherwise(F.col(context)), F.lit("\n\nReply with one JSON object: "), say(REPLY))


def site_hash() -> Column:
    """Names a site by what it says, so that it is asked about once."""
    return content_hash(F.col("file"), F.col("line"), F.col("expr"))


def answers(sites: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """sites(gap, slug, kind, prompt) put to a model: (gap, slug, kind, method, value, host, told), one row a site; ``told`` if it said something usable."""
    ship(sites.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            rows = []
            for gap, slug, kind, prompt in frame[["gap", "slug", "kind", "prompt"]].itertuples(index=False):
                said = answer(prompt) or ""
                try:
                    made = json.loads(said[said.index("{") : said.rindex("}") + 1])
                except ValueError:
                    made = {}
                made = made if isinstance(made, dict) else {}
                method = str(made.get("direction" if kind == "event" else "method") or "").upper()
                value = str(made.get("channel" if kind == "event" else "path") or "").strip()
                rows.append((gap, slug, kind, method, value, made.get("host") or None, made.get("resolved", True) is not False and bool(value)))
            yield pd.DataFrame(rows, columns=["gap", "slug", "kind", "method", "value", "host", "told"])

    return sites.select("gap", "slug", "kind", "prompt").mapInPandas(run, "gap string, slug string, kind string, method string, value string, host string, told boolean")


def judged(said: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """``said`` with ``status``: unresolved, malformed, ungrounded, duplicate, or filled.

    A route starts with a slash and has a verb, a channel a direction; the value must stand quoted in the
    repository's texts (slug, text), and what is known (slug, method, path) is never overwritten.
    """
    shaped = F.when(F.col("kind") == "event", F.col("method").isin("PUBLISH", "CONSUME")).otherwise(F.col("value").startswith("/") & F.col("method").isin(*VERBS))
    fit = said.filter(F.col("told") & shaped)
    sure = grounded(fit.select("slug", "value").distinct(), texts).select("slug", "value").distinct().withColumn("_sure", F.lit(True))
    held = known.select("slug", "method", F.col("path").alias("value")).distinct().withColumn("_known", F.lit(True))
    rows = said.join(sure, ["slug", "value"], "left").join(held, ["slug", "method", "value"], "left")
    status = F.when(~F.col("told"), "unresolved").when(~shaped, "malformed").when(F.col("_sure").isNull(), "ungrounded").when(F.col("_known"), "duplicate").otherwise("filled")
    return rows.select("gap", "slug", "kind", "method", F.col("value").alias("path"), "host", status.alias("status"))


def fill(sites: DataFrame, done: DataFrame, known: DataFrame, symbols: DataFrame, texts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """Sites (slug, kind, file, line, expr, method, snippet, names[]) not asked about before (done: gap), asked and judged; texts(slug, path, text)."""
    new = sites.withColumn("gap", site_hash()).join(done.select("gap"), "gap", "left_anti").dropDuplicates(["gap", "slug"])
    asked = new.join(gap_context(new, symbols, texts), "gap").withColumn("prompt", gap_prompt())
    return judged(answers(asked, answer), known, texts).withColumn("source", F.lit("llm"))


def counters(filled: DataFrame) -> DataFrame:
    """How many sites came to which end."""
    return filled.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
