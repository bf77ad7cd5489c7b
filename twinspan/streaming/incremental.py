"""Incremental fingerprints as a stream: new files in, window hashes appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinspan.operators.lexing import windows
from twinspan.sources.ignore import ingest_status

CORPUS_SCHEMA = "path string, text string"


def fingerprint_stream(spark: SparkSession, source: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """Token windows of every file that arrives in a Parquet folder and passes ingestion."""
    files = spark.readStream.schema(schema).parquet(source).filter("path IS NOT NULL AND text IS NOT NULL")
    ok = ingest_status(F.col("path"), F.col("text"), F.octet_length("text")) == "ok"
    return windows(files.filter(ok).select("path", "text"))


def append_fingerprints(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of all files there are, then stop."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
