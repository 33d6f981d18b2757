"""Verdicts on URLs: rules first, then logistic regression on hashed character n-grams of host and path.

Main path: DataFrame and SQL functions only. Rules are looked up row by row in a map of their hosts, without a
join. The model is trained from a small labelled URL table by steps over all of it: margins and gradients are
DataFrame aggregations, the driver adds one number per bucket to the weights. The weights go into the plan as one
array, so every other URL is judged in the same stage that reads it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Workspace, only

#: Rules of the registered query, as verdict, host, path: fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK, ALLOW = "block", "allow"
#: N-grams of these lengths fall into 2 ** BITS buckets.
GRAMS, BITS = (3, 4), 12
#: Training: at most so many distinct URLs of each verdict, in hash order, of at most so many code points each; steps over all of them.
SAMPLE_URLS, SAMPLE_LENGTH, STEPS = 1_000, 2_000, 16
RATE, L2 = 0.5, 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (from there up to ``?``, ``#`` or the end); both empty without ``://``."""
    at = F.instr(F.col(f"`{url}`"), "://")
    behind = F.when(at > 0, F.substr(F.col(f"`{url}`"), at + 3))
    host = F.translate(F.regexp_extract(behind, "^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(behind, "^[^/?#]*([^?#]*)", 1), F.lit(""))})


def _constant(value, schema: str) -> Column:
    """A literal that the optimizer folds once, whatever its size."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def rule_of(rules=RULES) -> Column:
    """The longest rule (struct rule, verdict) that fits ``host`` and ``path``, else null; of equally long ones that of the longest host, then the first by name.

    A rule fits its host and all subdomains if the path starts with its path. Only as many labels of a host
    are looked up as the longest rule's host has.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted({(host, path): verdict for verdict, host, path in rules}.items(), key=lambda x: (-len(x[0][0] + x[0][1]), -len(x[0][0]), x[0]))
    by_host: dict[str, list[dict]] = {}
    for i, ((host, path), verdict) in enumerate(order):
        by_host.setdefault(host, []).append({"place": i, "path": path, "rule": host + path, "verdict": verdict})
    known = _constant(by_host, "map<string, array<struct<place: int, path: string, rule: string, verdict: string>>>")
    most = max(h.count(".") + 1 for h in by_host)
    hosts = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, most + 1))))
    found = F.flatten(F.transform(hosts, lambda h: F.coalesce(F.try_element_at(known, h), F.array().cast("array<struct<place: int, path: string, rule: string, verdict: string>>"))))
    first = F.array_min(F.filter(found, lambda r: F.startswith(F.col("path"), r["path"])))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def with_letters(urls: DataFrame) -> DataFrame:
    """Add the code points of host and path, each with its ends marked; computed once per row, not once per n-gram."""
    return urls.withColumns({f"_{c}": F.split(F.concat(F.lit("^"), F.col(c), F.lit("$")), "") for c in ("host", "path")})


def buckets() -> Column:
    """Distinct buckets of the character n-grams of the columns of ``with_letters``."""
    def grams(part: str, n: int) -> Column:
        starts = F.when(F.size(part) >= n, F.sequence(F.lit(0), F.size(part) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), F.concat(*(F.get(part, i + j) for j in range(n)))), F.lit(1 << BITS)).cast("int"))

    return F.array_distinct(F.concat(*(grams(part, n) for part in ("_host", "_path") for n in GRAMS)))


def margin(weights: list[float], found: Column) -> Column:
    """Bias plus the weights of the buckets; ``weights`` has the bias last."""
    at = _constant(weights, "array<double>")
    return F.aggregate(found, F.lit(float(weights[-1])), lambda s, b: s + F.get(at, b))


def sample(labelled: DataFrame, per_class: int = SAMPLE_URLS) -> DataFrame:
    """At most ``per_class`` distinct URLs (host, path, label) of each verdict, by hash; a URL with both verdicts counts as blocked."""
    short = labelled.filter(F.col("label").isin(BLOCK, ALLOW) & (F.length("host") + F.length("path") <= SAMPLE_LENGTH))
    each = short.groupBy("host", "path").agg(F.max("label").alias("label"))
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
    return each.filter(F.col("label") == BLOCK).orderBy(*order).limit(per_class).unionByName(each.filter(F.col("label") == ALLOW).orderBy(*order).limit(per_class))


def train(labelled: DataFrame, per_class: int = SAMPLE_URLS) -> list[float]:
    """Weights of the buckets and the bias from a table (host, path, label); classes weigh alike. With one class or none the bias alone decides: that class, else allow.

    Every step is one aggregation over the sample (at most ``2 * per_class`` URLs); each coordinate has a
    rate of its own, which falls with the gradients it has seen.
    """
    space = Workspace(labelled.sparkSession, "url-filter")
    chosen = space.save(sample(labelled, per_class), "sample")
    count = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [0.0] * ((1 << BITS) + 1)
    if len(count) < 2:
        weights[-1] = 1.0 if BLOCK in count else -1.0
        return weights
    y = (F.col("label") == BLOCK).cast("double")
    scale = F.when(F.col("label") == BLOCK, 0.5 / count[BLOCK]).otherwise(0.5 / count[ALLOW])
    rows = space.save(with_letters(chosen).select(y.alias("y"), scale.alias("scale"), buckets().alias("found")).coalesce(1 + 2 * per_class // 1_000), "rows")
    seen = [0.0] * len(weights)
    for _ in range(STEPS):
        slope = F.col("scale") * (1 / (1 + F.exp(-margin(weights, F.col("found")))) - F.col("y"))
        each = rows.select(slope.alias("g"), F.explode(F.concat("found", F.array(F.lit(1 << BITS)))).alias("bucket"))
        for r in each.groupBy("bucket").agg(F.sum("g").alias("g")).collect():  # at most one row per bucket
            g = r["g"] + L2 * weights[r["bucket"]]
            seen[r["bucket"]] += g * g
            weights[r["bucket"]] -= RATE * g / (1e-6 + math.sqrt(seen[r["bucket"]]))
    return [round(w, 9) for w in weights]


def url_verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url: str = "url", id: str = "page_id") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    The longest fitting rule decides; where none fits, the model, trained on ``labelled`` (url, label: allow or
    block) or, without it, on URLs of ``pages`` on which a rule fits. Null URLs and such without ``://`` have
    empty host and path, which no rule fits unless its host is empty. Repeated rows share their verdict; URLs
    of any length are judged whole, though only those of ``SAMPLE_LENGTH`` teach. An empty table gives an
    empty result. Other columns are not read.
    """
    slim = with_host(only(pages, id, url).toDF("page_id", "_url"), "_url").withColumn("_fits", rule_of(rules))
    if labelled is None:
        known = slim.filter("_fits is not null").select("host", "path", F.col("_fits.verdict").alias("label"))
    else:
        known = with_host(only(labelled, "url", "label")).select("host", "path", "label")
    weights = train(known)
    judged = F.when(margin(weights, buckets()) > 0, BLOCK).otherwise(ALLOW)
    return with_letters(slim).select("page_id", "host", "path", F.col("_fits.rule").alias("rule"), F.when(F.col("_fits").isNotNull(), F.col("_fits.verdict")).otherwise(judged).alias("verdict"))
