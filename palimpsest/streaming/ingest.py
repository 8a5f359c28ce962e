"""Structured Streaming: documents that arrive as files are scanned batch by batch (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.docx import scan_docx
from palimpsest.sources.inputs import validate

FILES = "path string, modificationTime timestamp, length long, content binary"


def scan_stream(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Start a query that writes units and errors of new DOCX files under ``folder`` to ``target``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").load(folder)

    def one_batch(batch: DataFrame, number: int) -> None:
        docs = validate(batch.select(F.col("path").alias("name"), F.lit("docx").alias("format"), "content"))
        good = docs.where("error is null").select("name", scan_docx(F.col("content")).alias("s"))
        bad = docs.where("error is not null").select("name", F.col("error.code").alias("error"))
        out = good.select("name", "s.units", "s.warnings", "s.error").unionByName(bad, allowMissingColumns=True)
        out.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
