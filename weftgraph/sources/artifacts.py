"""Intermediate JSON artifacts and evaluation rows, read and written with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CALL_GRAPH, SKIPPED

INTERFACES = "id string, type string, method string, path string, handler string, framework string, evidence array<string>"
QUESTION = "id string, corpus string, category string, cross_repo boolean, entity string, prompt string, ground_truth array<string>, acceptable array<string>, aliases map<string,array<string>>, evidence array<string>"
RUN = "id string, arm string, parsed_answer struct<answer:array<string>>, new_tokens long, num_turns int, wall_s double, error string"


def read_interfaces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"interfaces array<struct<{_fields(INTERFACES)}>>").option("multiLine", True).json(path).select(F.explode("interfaces").alias("i")).select("i.*")


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"skipped array<struct<{_fields(SKIPPED)}>>").option("multiLine", True).json(path).select(F.explode("skipped").alias("s")).select("s.*")


def read_call_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    made = spark.read.schema(CALL_GRAPH).option("multiLine", True).json(path)
    return made.select(F.explode("nodes").alias("n")).select("n.*"), made.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.weight")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs with their answers; a run with an error has none and is scored as zero."""
    return spark.read.schema(RUN).json(path).withColumn("scored", F.col("error").isNull()).withColumn("answer", F.when(F.col("error").isNull(), F.col("parsed_answer.answer"))).drop("parsed_answer")


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _fields(ddl: str) -> str:
    return ",".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))
