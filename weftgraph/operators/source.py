"""Source text of a symbol, given only if it is the text that was indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import file_hash, source_span


def roots(slugs: DataFrame, services: DataFrame, libraries: DataFrame) -> DataFrame:
    """slug -> root: a service's before a library's."""
    s, x = services.select("slug", F.col("root").alias("_s")), libraries.select("slug", F.col("root").alias("_l"))
    return slugs.join(s, "slug", "left").join(x, "slug", "left").select("slug", F.coalesce("_s", "_l").alias("root"))


def get_source(symbols: DataFrame, texts: DataFrame, context: int = 0, most: int = 200) -> DataFrame:
    """symbols(id, path, line_start, line_end, file_sha), texts(path, rank, text): status, span and text per symbol.

    Of a file's candidate texts the first by ``rank`` whose hash is the recorded one is used; without a
    recorded hash the first is, marked unverified; if none fits the span is refused.
    """
    hashed = symbols.join(texts.withColumn("_sha", file_hash("text")), "path", "left")
    fits = F.col("file_sha").isNull() | (F.col("_sha") == F.col("file_sha"))
    best = hashed.groupBy("id", "line_start", "line_end", "file_sha").agg(F.count("text").alias("_n"), F.min_by("text", F.when(fits & F.col("text").isNotNull(), F.col("rank"))).alias("_text"))
    span = source_span("_text", F.col("line_start"), F.col("line_end"), context, most)
    status = F.when(F.col("_n") == 0, "unavailable").when(F.col("_text").isNull(), "span_mismatch").otherwise("ok")
    return best.select("id", status.alias("status"), F.col("file_sha").isNotNull().alias("verified"), F.when(F.col("_text").isNotNull(), span).alias("span"))


def skip_reasons(skipped: DataFrame) -> DataFrame:
    """Sites left out, by reason, and whether the file could be read at all."""
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "unparseable").alias("unreadable"))
