"""Whole comparisons: units of both sides to rows and a result per pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import omit_lines, text_evidence, utf16_length
from palimpsest.operators.align import align
from palimpsest.operators.diff import any_change, compare_rows
from palimpsest.operators.moves import reclassify_moves, summarize
from palimpsest.operators.raster import page_differences, pixel_budget, signature_of
from palimpsest.schema import LIMITS, CompareError, Options
from palimpsest.sources.ocr import Engine, enrich, selected_pages
from palimpsest.sources.png import png_size
from palimpsest.stage import materialize


@dataclass(frozen=True)
class Comparison:
    """Rows and a result per pair; ``errors(pair_id, error)`` of pairs that were rejected and have neither."""

    rows: DataFrame
    results: DataFrame
    errors: DataFrame | None = None


def compare_blocks(units: DataFrame, options: Options | None = None, warnings: DataFrame | None = None) -> Comparison:
    """Paragraphs and table rows (schema.UNIT); ``warnings(pair_id, warnings)`` make a pair incomplete.

    OCR is for pages: options that ask for it are rejected.
    """
    options = (options or Options()).check()
    if options.ocr_enabled or options.ocr_before_pages or options.ocr_after_pages:
        raise CompareError("INVALID_INPUT", "OCR pages can be selected for PDF documents only")
    units = materialize(units, "units")
    rows = compare_rows(materialize(align(units), "aligned"), units, options)
    evidence = lambda s: F.when(F.col(f"{s}_idx").isNotNull(), "docx-xml").otherwise("none")
    rows = materialize(rows.withColumns({"before_evidence": evidence("before"), "after_evidence": evidence("after"), "move_id": F.lit(None).cast("string")}), "rows")
    if options.detect_moves:
        rows = materialize(reclassify_moves(rows, options), "moved-rows")
    return Comparison(rows, summarize(rows, warnings))


def _page_rows(units: DataFrame, options: Options) -> DataFrame:
    trimmed = units.withColumn("text", omit_lines(F.col("text"), options.ignore_header_lines, options.ignore_footer_lines))
    rows = compare_rows(materialize(align(trimmed, pages=True), "aligned"), units, options, "page")
    return rows.withColumns({"before_evidence": text_evidence(F.col("before_text")), "after_evidence": text_evidence(F.col("after_text")), "move_id": F.lit(None).cast("string")})


def _with_pixels(rows: DataFrame) -> DataFrame:
    """A pair of pages with a changed pixel is changed."""
    differs = any_change(F.col("changes")) | (F.coalesce("changed_pixels", F.lit(0)) > 0)
    return rows.withColumn("status", F.when(F.col("status").isin("added", "removed"), F.col("status")).when(differs, "changed").otherwise("unchanged"))


def compare_pages(units: DataFrame, options: Options | None = None, rasters: DataFrame | None = None) -> Comparison:
    """Pages, aligned by text and grayscale samples, without images.

    ``rasters(pair_id, before_idx, after_idx, changed_pixels, total_pixels)`` from
    operators.raster: a changed pixel changes a row.  Blank pages make a pair incomplete.
    """
    options = (options or Options()).check()
    rows = _page_rows(materialize(units, "units"), options)
    if rasters is not None:
        rows = rows.join(rasters, ["pair_id", "before_idx", "after_idx"], "left")
    else:
        rows = rows.withColumns({"changed_pixels": F.lit(None).cast("long"), "total_pixels": F.lit(None).cast("long")})
    rows = materialize(_with_pixels(rows), "rows")
    if options.detect_moves:
        rows = materialize(reclassify_moves(rows, options), "moved-rows")
    return Comparison(rows, summarize(rows, page_warnings(rows, options)))


def compare_pdf(units: DataFrame, images: DataFrame, options: Options | None = None, engine: Engine | None = None) -> Comparison:
    """The whole comparison of pages: alignment, pixels, OCR, warnings, moves, pixels of moved pages, summary.

    ``images(pair_id, side, unit_index, png)`` has a rendered page for each unit; where units have no
    sample it is taken from its image.  Text that OCR reads takes part in moves.  A pair past a
    limit, or whose selected pages can't be read, is an error and has no rows.
    """
    options = (options or Options()).check()
    if options.ocr_enabled and not selected_pages(options):
        raise CompareError("INVALID_INPUT", "OCR needs a selected page")
    samples = images.select("pair_id", "side", "unit_index", signature_of(F.col("png")).alias("seen"))
    units = units.join(samples, ["pair_id", "side", "unit_index"], "left").withColumn("sample", F.coalesce("sample", "seen")).drop("seen")
    units = materialize(units, "units")
    rows = _page_rows(units, options)

    def pixels(rows: DataFrame, only: str | None = None) -> DataFrame:
        told = page_differences(rows, images, options.visual_threshold, only)
        return told.withColumns({c: F.coalesce(f"visual.{c}", c) if c in rows.columns else F.col(f"visual.{c}") for c in ("overlay", "changed_pixels", "total_pixels")}).withColumn("pixel_error", F.coalesce("visual.error", "pixel_error") if "pixel_error" in rows.columns else F.col("visual.error")).drop("visual")

    rows = materialize(_with_pixels(pixels(materialize(rows, "rows"))), "rows")
    sizes = images.select("pair_id", png_size(F.col("png")).alias("size")).select("pair_id", "size.*")
    errors = [pixel_budget(sizes).select("pair_id", "error"), rows.select("pair_id", F.col("pixel_error").alias("error"))]
    errors.append(text_budget(units))
    notes = None
    if options.ocr_enabled:
        rows, notes, failed = enrich(rows, images, options, engine)
        rows = materialize(rows, "recognized")
        notes, failed = materialize(notes, "ocr-notes"), materialize(failed, "ocr-errors")
        errors.append(failed)
    if options.detect_moves:
        rows = pixels(materialize(reclassify_moves(rows, options), "moved-rows"), "moved")
        errors.append(rows.select("pair_id", F.col("pixel_error").alias("error")))
    found = errors[0]
    for e in errors[1:]:
        found = found.unionByName(e)
    found = materialize(found.where("error is not null").groupBy("pair_id").agg(F.min("error").alias("error")), "errors")
    rows = materialize(rows.drop("pixel_error").join(found, "pair_id", "left_anti"), "compared")
    warnings = page_warnings(rows, options)
    if notes is not None:
        both = notes.withColumnRenamed("warnings", "first").join(warnings, "pair_id", "full")
        none = F.array().cast("array<string>")
        warnings = both.select("pair_id", F.concat(F.coalesce("first", none), F.coalesce("warnings", none)).alias("warnings"))
    return Comparison(rows, summarize(rows, warnings), found)


def page_warnings(rows: DataFrame, options: Options) -> DataFrame:
    """pair_id, warnings: pages of both sides together that no text is known of."""
    empty = [F.count_if(F.col(f"{s}_idx").isNotNull() & (F.col(f"{s}_evidence") == "none")) for s in ("before", "after")]
    told = "still have no text after OCR of the selected pages" if options.ocr_enabled else "have no selectable text; no OCR was asked for"
    message = F.concat(F.col("n").cast("string"), F.lit(f" page(s) {told}"))
    counts = rows.groupBy("pair_id").agg((empty[0] + empty[1]).alias("n"))
    return counts.where("n > 0").select("pair_id", F.array(message).alias("warnings"))


def text_budget(units: DataFrame, most: int = LIMITS["total_chars"]) -> DataFrame:
    """pair_id, error of pairs whose texts, both sides together, or one of whose units is too long."""
    size = utf16_length(F.coalesce("text", F.lit(""))).cast("long")
    sums = units.groupBy("pair_id").agg(F.sum(size).alias("chars"), F.max(size).alias("longest"))
    return sums.where((F.col("chars") > most) | (F.col("longest") > LIMITS["unit_chars"])).select("pair_id", F.lit("TEXT_LIMIT_EXCEEDED").alias("error"))


def document_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of a text table as units: lines with `` | `` are table rows with those cells, others paragraphs."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.posexplode(F.split(text, "\n")).alias("unit_index", "text"))
    row = F.contains(F.col("text"), F.lit(" | "))
    return lines.select(
        doc_id,
        "unit_index",
        F.when(row, "table-row").otherwise("paragraph").alias("kind"),
        "text",
        F.when(row, F.split("text", r" \| ")).alias("cells"),
    )


def shared_line_pairs(docs: DataFrame, least: int = 2, most: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidate revisions (before, after): documents that share a line found in ``least`` to ``most`` documents.

    The bounds are what makes a candidate: a line that more documents have says nothing of a
    revision, so documents whose common lines are all that frequent are no candidates.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.explode(F.split(text, "\n")).alias("line")).where(F.trim("line") != "").select("d", F.xxhash64("line").alias("h")).distinct()
    few = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).select("h")
    own = lines.join(few, "h")
    return own.select("h", F.col("d").alias("before")).join(own.select("h", F.col("d").alias("after")), "h").where("before < after").select("before", "after").distinct()


def revision_units(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """schema.UNIT of both sides of ``pairs(before, after)`` over a documents table."""
    units = document_units(docs)
    sides = []
    for side in ("before", "after"):
        own = pairs.select(F.concat_ws("-", "before", "after").alias("pair_id"), F.lit(side).alias("side"), F.col(side).alias("doc_id"))
        sides.append(own.join(units, "doc_id").drop("doc_id"))
    both = sides[0].unionByName(sides[1])
    none = F.lit(None).cast("int")
    return both.select("pair_id", "side", "unit_index", "kind", none.alias("table_index"), none.alias("row_index"), "text", "cells", F.lit(None).cast("array<int>").alias("sample"))
