"""Reading captures, tables and message envelopes; missing tables are empty, bad records are kept apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """schemaVersion int, source string, kind string, url string, canonicalUrl string, title string, author string,
publishedAt string, collectedAt string, html string, text string, images array<struct<url: string, alt: string>>, truncated boolean,
questioner string, suggestedCategory string, suggestedTags array<string>, userCategory string, userTags array<string>,
sourceMetadata map<string, string>, seq bigint"""
ENVELOPE = "type string, requestId string, timestamp string, payload string"


def table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A table with a fixed schema; no folder is an empty table, any other failure is raised."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and lines that aren't JSON of the schema (``value``)."""
    lines = spark.read.text(path)
    read = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = read.where("r is not null and r._bad is null").select("r.*").drop("_bad")
    return good, read.where("r is null or r._bad is not null").select("value")


def envelopes(lines: DataFrame, types: tuple[str, ...] = ("hello", "ping", "progress", "result", "error"), most: int = 12_000_000) -> tuple[DataFrame, DataFrame]:
    """Messages with a known type and request, and dead letters with a reason; works on batches and streams. lines: (value)."""
    read = lines.withColumn("m", F.from_json("value", ENVELOPE))
    reason = (
        F.when(F.length("value") > most, "too long").when(F.col("m").isNull() | F.col("m.type").isNull(), "malformed")
        .when(~F.col("m.type").isin(*types), "unknown type").when(~F.col("m.type").isin("hello", "ping") & F.col("m.requestId").isNull(), "no request")
    )
    judged = read.withColumn("reason", reason)
    return judged.where("reason is null").select("m.*"), judged.where("reason is not null").select("value", "reason")
