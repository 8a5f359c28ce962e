"""OCR of selected blank pages through an injected engine; none is bundled."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank, omit_lines, utf16_length
from palimpsest.operators.diff import any_change, changes_udf, single_change
from palimpsest.operators.moves import HARMLESS
from palimpsest.schema import LIMITS, Options
from palimpsest.sources.png import URL_BYTES, png_size
from palimpsest.stage import materialize

#: Takes PNG bytes, returns text and a confidence of 0 to 100 or None.
Engine = Callable[[bytes], tuple[str, float | None]]
RESULT = "struct<text:string,confidence:double,error:string>"


def recognize(engine: Engine | None):
    """Column function PNG -> text, confidence, error code."""

    @F.pandas_udf(RESULT)
    def run(images: pd.Series) -> pd.DataFrame:
        out = []
        for raw in images:
            if raw is None:
                out.append((None, None, None))
                continue
            try:
                text, confidence = engine(bytes(raw))
                text = text.replace("\r\n", "\n").replace("\r", "\n")
                out.append((text, None if confidence is None else float(min(100, max(0, confidence))), None))
            except Exception:  # noqa: BLE001  an engine's failure is a result, not the job's
                out.append((None, None, "OCR_FAILED"))
        return pd.DataFrame(out, columns=["text", "confidence", "error"])

    return run


def selected_pages(options: Options) -> list[tuple[str, int]]:
    """In the order they are read: before, then after."""
    return [*(("before", p) for p in options.ocr_before_pages), *(("after", p) for p in options.ocr_after_pages)]


def _both_sides(rows: DataFrame, *columns: str) -> DataFrame:
    """pair_id, side, unit_index and the columns of either side."""
    one = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_idx").alias("unit_index"), *[F.col(f"{s}_{c}").alias(c) for c in columns])
    return rows.select("pair_id", F.inline(F.array(one("before"), one("after")))).where("unit_index is not null")


def enrich(rows: DataFrame, images: DataFrame, options: Options, engine: Engine | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with recognised text for selected blank pages, warnings by pair, and errors by pair.

    ``images(pair_id, side, unit_index, png)``.  Alignment stays; changes and status follow the new
    text.  Selected pages with text are skipped with a warning; the filter stands below the engine.
    The first failure in the order of selection is the pair's error: a page that doesn't exist, an
    image that is missing or too large, an engine that is missing or fails, too much text.
    """
    pages = [F.struct(F.lit(i).alias("place"), F.lit(side).alias("side"), F.lit(p).alias("unit_index")) for i, (side, p) in enumerate(selected_pages(options))]
    asked = rows.select("pair_id").distinct().select("pair_id", F.inline(F.array(*pages)))  # at most 20 rows a pair
    picked = asked.join(_both_sides(rows, "text"), ["pair_id", "side", "unit_index"], "left").withColumnRenamed("text", "old")
    missing = picked.where("old is null").select("pair_id", "place", F.lit("INVALID_INPUT").alias("error"))
    page = F.concat_ws(" ", "side", (F.col("unit_index") + 1).cast("string"))
    skipped = picked.where(F.col("old").isNotNull() & ~is_blank(F.col("old"))).select("pair_id", F.concat_ws(" ", F.lit(HARMLESS), page).alias("warning"))
    read = picked.where(F.col("old").isNotNull() & is_blank(F.col("old"))).join(images, ["pair_id", "side", "unit_index"], "left")
    size = png_size(F.col("png"))
    read = read.withColumn("pixels", size["width"] * size["height"])
    early = F.when(F.col("pixels").isNull() | (F.octet_length("png") > URL_BYTES), "OCR_FAILED").when(~F.col("pixels").between(1, LIMITS["ocr_page_pixels"]), "PIXEL_LIMIT_EXCEEDED")
    early = F.lit("OCR_UNAVAILABLE") if engine is None else early
    read = read.withColumn("early", early).withColumn("r", recognize(engine)(F.when(F.col("early").isNull(), F.col("png"))))
    too_long = F.when(utf16_length(F.col("r.text")) > LIMITS["unit_chars"], "TEXT_LIMIT_EXCEEDED")
    read = materialize(read.select("pair_id", "place", "side", "unit_index", "pixels", "r.text", "r.confidence", F.coalesce("early", "r.error", too_long).alias("error")), "ocr")
    chars = rows.groupBy("pair_id").agg(F.sum(utf16_length(F.concat(F.coalesce("before_text", F.lit("")), F.coalesce("after_text", F.lit("")))).cast("long")).alias("chars"))
    sums = read.groupBy("pair_id").agg(F.sum("pixels").alias("pixels"), F.sum(utf16_length(F.col("text")).cast("long")).alias("more")).join(chars, "pair_id")
    over = F.when(F.col("pixels") > LIMITS["ocr_pixels"], "PIXEL_LIMIT_EXCEEDED").when(F.col("chars") + F.coalesce("more", F.lit(0)) > LIMITS["total_chars"], "TEXT_LIMIT_EXCEEDED")
    failed = read.select("pair_id", "place", "error").unionByName(missing).unionByName(sums.select("pair_id", F.lit(LIMITS["ocr_pages"]).alias("place"), over.alias("error")))
    failed = failed.where("error is not null").groupBy("pair_id").agg(F.min_by("error", "place").alias("error"))
    page_note = lambda code, when: F.when(when, F.concat_ws(" ", F.lit(code), page))
    notes = F.array_compact(
        F.array(
            F.lit("OCR_HEURISTIC"),
            page_note("OCR_EMPTY", is_blank(F.col("text"))),
            page_note("OCR_NO_CONFIDENCE", F.col("confidence").isNull()),
            page_note("OCR_LOW_CONFIDENCE", F.col("confidence") < options.ocr_minimum_confidence),
        )
    )
    told = skipped.unionByName(read.where("error is null").select("pair_id", F.explode(notes).alias("warning")))
    told = told.groupBy("pair_id").agg(F.sort_array(F.collect_set("warning")).alias("warnings"))
    out = rows
    for side in ("before", "after"):
        own = read.where((F.col("side") == side) & F.col("error").isNull()).select("pair_id", F.col("unit_index").alias(f"{side}_idx"), F.col("text").alias("_t"), F.col("confidence").alias(f"{side}_confidence"))
        out = out.join(own, ["pair_id", f"{side}_idx"], "left")
        new = F.col("_t").isNotNull()
        out = out.withColumns({f"{side}_text": F.coalesce("_t", f"{side}_text"), f"{side}_evidence": F.when(new, "ocr").otherwise(F.col(f"{side}_evidence"))}).drop("_t")
    left, right = F.col("before_idx").isNotNull(), F.col("after_idx").isNotNull()
    touched = (F.col("before_evidence") == "ocr") | (F.col("after_evidence") == "ocr")
    trim = lambda c: F.coalesce(omit_lines(F.col(c), options.ignore_header_lines, options.ignore_footer_lines), F.lit(""))
    fresh = F.when(left & right, changes_udf(options.ignore_whitespace)(trim("before_text"), trim("after_text")))
    fresh = F.coalesce(fresh, F.when(left, single_change(F.col("before_text"), "removed")).otherwise(single_change(F.col("after_text"), "added")))
    out = out.withColumn("changes", F.when(touched, fresh).otherwise(F.col("changes")))
    pixels = F.coalesce("changed_pixels", F.lit(0)) > 0 if "changed_pixels" in rows.columns else F.lit(False)
    status = F.when(any_change(F.col("changes")) | pixels, "changed").otherwise("unchanged")
    return out.withColumn("status", F.when(touched & left & right, status).otherwise(F.col("status"))), told, failed
