"""Document files as rows, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import display_name, format_of, utf16_length
from palimpsest.schema import LIMITS

ERROR = "struct<code:string,message:string>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, format (by extension), content, sha256 of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("name"), format_of(F.col("path")).alias("format"), "content").withColumn("sha256", F.sha2("content", 256))


def find_bytes(content: Column, pattern: bytes, within: int | None = None) -> Column:
    """Zero-based place of a byte pattern in the first ``within`` bytes, -1 if it isn't there."""
    # in ISO-8859-1 each byte is one character
    where = F.decode(F.substring(content, 1, within) if within else content, "ISO-8859-1")
    return F.instr(where, pattern.decode("latin-1")) - 1


def _error(code: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))


def validate(docs: DataFrame, version: int = 2) -> DataFrame:
    """Add display_name and error (null if sound) to rows of name, content and, for version 2, format.

    Version 1 takes PDF only and looks for ``PDF-``; version 2 holds the bytes against the
    declared format.  A bad document never fails the job.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    zipped = F.hex(F.substring("content", 1, 2)) == "504B"
    common = (
        F.when(F.col("name").isNull() | F.col("content").isNull() | (size == 0), _error("INVALID_INPUT", "the document is empty"))
        .when(size > LIMITS["document_bytes"], _error("INPUT_TOO_LARGE", "a document may have 50 MiB"))
        .when(utf16_length(F.col("name")) > 1024, _error("INVALID_INPUT", "the name is too long"))
    )
    if version == 1:
        missing = find_bytes(F.col("content"), b"PDF-", 1024) < 0
        error = common.when(missing & zipped, _error("UNSUPPORTED_FORMAT", "ZIP packages aren't PDF")).when(missing, _error("PDF_DECODE_FAILED", "no PDF header"))
    else:
        pdf = F.col("format") == "pdf"
        error = (
            common.when(~F.coalesce(F.col("format").isin("pdf", "docx"), F.lit(False)), _error("INVALID_INPUT", "the format must be pdf or docx"))
            .when(pdf & (find_bytes(F.col("content"), b"%PDF-", 1024) < 0), _error("FORMAT_MISMATCH", "the bytes aren't PDF"))
            .when(~pdf & ~zipped, _error("FORMAT_MISMATCH", "the bytes are no ZIP package"))
        )
    return docs.withColumns({"display_name": display_name(F.col("name")), "error": error.cast(ERROR)})


def pair_error(before_bytes: Column, after_bytes: Column, limit: int = LIMITS["pair_bytes"]) -> Column:
    return F.when(before_bytes + after_bytes > limit, "INPUT_TOO_LARGE")


def validate_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs(pair_id, before, after)`` of document names with the first error of either side, or of both together."""
    own = docs.select("name", "format", "error", F.octet_length("content").alias("n"))
    a, b = own.toDF("before", "fa", "ea", "na"), own.toDF("after", "fb", "eb", "nb")
    out = pairs.join(a, "before", "left").join(b, "after", "left")
    missing = F.when(F.col("na").isNull() | F.col("nb").isNull(), _error("INVALID_INPUT", "a document is missing"))
    mixed = F.when(F.col("fa") != F.col("fb"), _error("FORMAT_MISMATCH", "documents of different formats"))
    large = F.when(pair_error(F.col("na"), F.col("nb")).isNotNull(), _error("INPUT_TOO_LARGE", "a pair may have 100 MiB"))
    return out.select("pair_id", "before", "after", F.coalesce("ea", "eb", mixed, large, missing).cast(ERROR).alias("error"))
