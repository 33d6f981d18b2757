"""Exact deduplication by stateful streaming over disk-backed keyed state.

Main path: DataFrame and SQL functions only. A slim projection of the documents (digest, byte length, stable
identifier, content locator) is streamed through a keyed aggregation whose state lives in RocksDB on disk and
never expires. Per digest the state retains the identifier and locator of the row that stays and the number of
rows. Hits, that is digests of two or more rows, are then checked on the full bytes; a digest that two
different texts share is split by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, hot_keys, skew_safe_join

#: State on disk; without reserving disk ahead, as there is a store for every shuffle partition.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Column of the content locator.
LOCATOR = "__weft_locator"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(docs: DataFrame, space: Workspace) -> DataFrame:
    """Documents as one struct ``_doc``, with the locator (file, row) of their content; a table that is no file scan, or has a ``_metadata`` of its own, is written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(LOCATOR)
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    return docs.select(doc, place) if _is_scan(docs) else space.save(docs.select(doc), "docs").select("_doc", place)


def _is_scan(docs: DataFrame) -> bool:
    """Is every row a row of a file, and no file's row more than one? Only columns may be chosen and rows filtered above the scan: joins and explodes repeat a place."""
    if "_metadata" in docs.columns:
        return False
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    if node.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _keyed_state(slim: DataFrame, space: Workspace, spark: SparkSession) -> DataFrame:
    """Run the stream over the staged rows to its end and read what its state store holds."""
    stored = space.save(slim, "slim")
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(stored.schema).parquet(space.path("slim"))
        state = stream.groupBy("_digest", "_bytes").agg(
            F.max(F.struct(F.col("_id").alias("id"), F.col(LOCATOR).alias("locator"))).alias("keep"),
            F.count(F.lit(1)).alias("n"),
        )
        query = (
            state.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", space.path("stream")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    held = spark.read.format("statestore").load(space.path("stream"))
    keep, n = (F.col("value").getField(f) for f in held.schema["value"].dataType.fieldNames())
    return held.select(
        F.col("key._digest").alias("_digest"), F.col("key._bytes").alias("_bytes"), keep.getField("id").alias("_keep"),
        keep.getField("locator").alias("_keep_locator"), n.alias("_n"),
    )


def decide(docs: DataFrame, text: str, id: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Documents with their locator, and one slim row per document: _id, locator, _digest, _keep, _n, _kept."""
    spark = docs.sparkSession
    space = Workspace(spark, "exact-dedup")
    located = _located(docs, space)
    full = located.select(F.col(f"_doc.`{id}`").alias("_id"), LOCATOR, F.coalesce(F.col(f"_doc.`{text}`"), F.lit("")).alias("_body"))
    full = full.withColumn("_digest", digest(F.col("_body"))).withColumn("_bytes", F.octet_length("_body"))
    state = space.save(_keyed_state(full.drop("_body"), space, spark), "state")
    space.drop("stream")
    slim = spark.read.schema(full.drop("_body").schema).parquet(space.path("slim"))
    n_rows = slim.count()

    # Full bytes on hits: a group is whole if its least and its greatest text are the same.
    group = ["_digest", "_bytes"]
    # Large groups (at most 1000) find their texts by broadcast and shrink to two texts before anything moves.
    hits, large = state.filter("_n > 1"), hot_keys(state, "_n", n_rows)
    hot = F.broadcast(hits.filter(large).select(*group))
    hit_texts = full.join(hot, group, "left_semi").unionByName(
        full.join(hot, group, "left_anti").join(hits.filter(~large).select(*group).hint("merge"), group, "left_semi"))  # the same plan at every size
    clash = space.save(
        hit_texts.groupBy(*group).agg(F.min("_body").alias("_least"), F.max("_body").alias("_most"))
        .filter("_least <> _most").select(*group), "clash",
    )
    verdict = state.withColumn("_key", F.concat_ws(":", *group))
    rows = slim.withColumn("_key", F.concat_ws(":", *group))
    if not clash.isEmpty():  # there the text itself is the key; its equals are found on the full bytes
        apart = hit_texts.join(clash, group, "left_semi").withColumn("_key", F.concat(F.lit("="), "_body"))
        rows = rows.join(clash, group, "left_anti").select("_id", LOCATOR, "_digest", "_key").unionByName(apart.select("_id", LOCATOR, "_digest", "_key"))
        by_text = apart.groupBy("_key").agg(F.max(F.struct(F.col("_id").alias("id"), F.col(LOCATOR).alias("locator"))).alias("k"), F.count(F.lit(1)).alias("_n"))
        verdict = verdict.join(clash, group, "left_anti").select("_key", "_keep", "_keep_locator", "_n").unionByName(
            by_text.select("_key", F.col("k.id").alias("_keep"), F.col("k.locator").alias("_keep_locator"), "_n")
        )
    rows = skew_safe_join(rows.select("_id", LOCATOR, "_digest", "_key"), verdict.select("_key", "_keep", "_keep_locator", "_n"), "_key", "_n", n_rows)
    return located, rows.withColumn("_kept", F.col(LOCATOR) == F.col("_keep_locator")).drop("_key", "_keep_locator")


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Texts are compared unchanged; null text counts as empty. Of equal texts the row with the largest ``id``
    stays (a null id is the smallest); of rows that also share that id, the one with the greatest locator (a
    place in a file: what is no plain scan of files is written first). An
    empty table gives an empty result. Texts of any length are compared whole, on the executors. Other columns
    are not read, so their names cannot clash. The state of the stream serves one call and is deleted behind
    it; a later batch goes through with the documents before it. ``digest`` may be any function of the text: its collisions are resolved on the full bytes.
    """
    _, rows = decide(docs, text, id, digest)
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_digest").alias("digest"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    One row of each text stays, null and empty ones as one text; which, and what holds for repeated rows and
    an empty table, is as in ``exact_dedup``.
    """
    located, rows = decide(docs, text, id, digest)
    return located.join(rows.filter(~F.col("_kept")).select(LOCATOR), LOCATOR, "left_anti").select("_doc.*")
