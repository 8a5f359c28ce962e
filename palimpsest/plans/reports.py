"""JSON and HTML reports of comparisons, projected to a fixed schema and bounded in size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import clamp, display_name, html_escape, image_url, location_label, safe_count, safe_enum
from palimpsest.operators.diff import changed_cells
from palimpsest.plans.compare import Comparison
from palimpsest.schema import LIMITS, STATUSES, Options

LIMIT = LIMITS["report_bytes"]
STYLE = "body{font:15px/1.5 sans-serif;margin:2em;color:#222}article{border:1px solid #ccc;margin:1em 0;padding:1em}pre{white-space:pre-wrap}.added{background:#d8f3dc}.removed{background:#ffd6d9;text-decoration:line-through}"


def _location(side: str, fmt: str) -> Column:
    kind = F.col(f"{side}_kind")
    table = lambda c: F.when(kind == "table-row", F.coalesce(F.col(f"{side}_{c}"), F.lit(0)))
    where = F.struct(F.lit(fmt).alias("format"), kind.alias("kind"), F.col(f"{side}_idx").alias("index"), table("table_index").alias("tableIndex"), table("row_index").alias("rowIndex"))
    return F.when(F.col(f"{side}_idx").isNotNull(), where)


def row_struct(rows: DataFrame, version: int = 2, fmt: str = "docx") -> Column:
    """The exported fields of a row; everything else is dropped."""
    has = lambda c: c in rows.columns
    opt = lambda c, kind="string": F.col(c) if has(c) else F.lit(None).cast(kind)
    visual = F.when(
        opt("changed_pixels", "long").isNotNull(),
        F.struct(
            F.coalesce(image_url(opt("overlay")), F.lit("")).alias("diffImageDataUrl"),
            safe_count(opt("changed_pixels", "long")).alias("changedPixels"),
            safe_count(opt("total_pixels", "long")).alias("totalPixels"),
            clamp(F.coalesce(opt("changed_pixels", "long") / opt("total_pixels", "long"), F.lit(0.0)), 0.0, 1.0).alias("ratio"),
        ),
    )
    text = [F.coalesce(F.col(f"{s}_text"), F.lit("")).alias(f"{s}Text") for s in ("before", "after")]
    images = [image_url(opt(f"{s}_image")).alias(f"{s}ImageDataUrl") for s in ("before", "after")]
    if version == 1:
        status = safe_enum(F.col("status"), STATUSES[:4], "changed")
        return F.struct(F.left("row_id", F.lit(120)).alias("id"), status.alias("status"), F.col("before_idx").alias("beforePage"), F.col("after_idx").alias("afterPage"), *text, F.col("changes"), *images, visual.alias("visual"))
    evidence = lambda s: F.struct(
        F.coalesce(F.col(f"{s}_evidence"), F.lit("none")).alias("source"), F.when(opt(f"{s}_confidence", "double").isNotNull(), clamp(opt(f"{s}_confidence", "double"), 0.0, 100.0)).alias("confidence")
    )
    cells = F.transform("cell_changes", lambda c: F.struct(c["before_cell"].alias("beforeCellIndex"), c["after_cell"].alias("afterCellIndex"), c["changes"].alias("changes")))
    return F.struct(
        F.left("row_id", F.lit(120)).alias("id"),
        safe_enum(F.col("status"), STATUSES, "changed").alias("status"),
        F.when(F.col("status") == "moved", F.left("move_id", F.lit(120))).alias("moveId"),
        _location("before", fmt).alias("beforeLocation"),
        _location("after", fmt).alias("afterLocation"),
        *text,
        F.col("changes"),
        F.struct(evidence("before").alias("before"), evidence("after").alias("after")).alias("textEvidence"),
        F.col("before_cells").alias("beforeCells"),
        F.col("after_cells").alias("afterCells"),
        cells.alias("cellChanges"),
        *images,
        visual.alias("visual"),
    )


def documents_struct(fmt: str = "docx") -> Column:
    """Both documents' information, from columns before_name, before_sha256, before_units, and after's."""

    def one(s: str) -> Column:
        sha = F.lower(F.col(f"{s}_sha256"))
        unit = "pdf-page" if fmt == "pdf" else "docx-block"
        fields = [display_name(F.col(f"{s}_name")).alias("name"), F.lit(fmt).alias("format"), F.when(sha.rlike("^[a-f0-9]{64}$"), sha).otherwise("").alias("sha256"), F.lit(unit).alias("unitKind"), F.col(f"{s}_units").alias("unitCount")]
        return F.struct(*fields, *([F.col(f"{s}_units").alias("physicalPageCount")] if fmt == "pdf" else []))

    return F.struct(one("before").alias("before"), one("after").alias("after"))


def _with_info(c: Comparison, info: DataFrame | None) -> DataFrame:
    """Results with the documents' names and identities; without ``info``, the halves of the pair's id."""
    sizes = c.rows.groupBy("pair_id").agg(F.count("before_idx").alias("before_units"), F.count("after_idx").alias("after_units"))
    out = c.results.join(sizes, "pair_id", "left").na.fill(0, ["before_units", "after_units"])
    if info is not None:
        return out.join(info, "pair_id", "left")
    half = lambda i: F.element_at(F.split("pair_id", "-"), i)
    none = F.lit("")
    return out.withColumns({"before_name": half(1), "after_name": half(-1), "before_sha256": none, "after_sha256": none})


def _bounded(df: DataFrame, column: str, size: str, limit: int) -> DataFrame:
    """Replace a report over ``limit`` bytes by null and an error; there is no partial report."""
    out = df.withColumn(size, F.octet_length(column).cast("long"))
    over = F.col(size) > limit
    return out.withColumns({"error": F.when(over, "OUTPUT_LIMIT_EXCEEDED"), column: F.when(~over, F.col(column))})


def _ordered(rows: DataFrame, piece: Column, limit: int) -> DataFrame:
    """pair_id, parts: the rows' pieces in order; a pair past ``limit`` keeps only sizes."""
    told = rows.select("pair_id", "row_seq", piece.alias("piece"))
    sizes = told.groupBy("pair_id").agg(F.sum(F.octet_length("piece")).alias("bytes"))
    told = told.join(sizes, "pair_id").withColumn("piece", F.when(F.col("bytes") <= limit, F.col("piece")))
    return told.groupBy("pair_id").agg(F.max("bytes").alias("bytes"), F.transform(F.sort_array(F.collect_list(F.struct("row_seq", "piece"))), lambda x: x["piece"]).alias("parts"))


def _assembled(c: Comparison, info: DataFrame | None, piece: Column, head: Column, tail: Column, between: str, name: str, limit: int) -> DataFrame:
    base = _with_info(c, info).join(_ordered(c.rows, piece, limit), "pair_id", "left")
    body = F.array_join(F.coalesce("parts", F.array().cast("array<string>")), between)
    out = base.withColumn(name, F.concat(head, body, tail))
    out = _bounded(out, name, f"{name}_bytes", limit)
    over = F.coalesce(F.col("bytes") > limit, F.lit(False))
    return out.withColumns({"error": F.when(over, "OUTPUT_LIMIT_EXCEEDED").otherwise(F.col("error")), name: F.when(~over, F.col(name)), f"{name}_bytes": F.greatest(f"{name}_bytes", F.coalesce("bytes", F.lit(0)))})


def json_report(c: Comparison, options: Options | None = None, info: DataFrame | None = None, version: int = 2, fmt: str = "docx", limit: int = LIMIT) -> DataFrame:
    """pair_id, json, json_bytes, error: one compact report per pair, version 2 or the frozen PDF-only 1."""
    options = options or Options()
    # keys with null values stay out, but locations and pages are null by design
    piece = F.to_json(row_struct(c.rows, version, fmt))
    nulls = ["beforePage", "afterPage"] if version == 1 else ["beforeLocation", "afterLocation"]
    for field, side in zip(nulls, ("before", "after"), strict=True):
        piece = F.when(F.col(f"{side}_idx").isNull(), F.concat(F.lit(f'{{"{field}":null,'), F.substring(piece, F.lit(2), F.length(piece)))).otherwise(piece)
    base = {"ignoreWhitespace": options.ignore_whitespace, "ignoreHeaderLines": options.ignore_header_lines, "ignoreFooterLines": options.ignore_footer_lines, "visualThreshold": options.visual_threshold}
    if version == 2:
        ocr = {"enabled": options.ocr_enabled, "beforePageIndexes": options.ocr_before_pages, "afterPageIndexes": options.ocr_after_pages, "minimumConfidence": options.ocr_minimum_confidence}
        base |= {"detectMoves": options.detect_moves, "ocr": ocr}
    import json

    head = F.concat(F.lit(f'{{"schemaVersion":{version},"documents":'), F.to_json(documents_struct(fmt)), F.lit(f',"options":{json.dumps(base, separators=(",", ":"))},"rows":['))
    summary = F.to_json(F.struct(*STATUSES[: 4 if version == 1 else 5]))
    warnings = F.to_json(F.slice("warnings", 1, LIMITS["warnings"]))
    ends = [F.lit('],"summary":'), summary, F.lit(',"warnings":'), warnings, F.lit(',"outcome":"'), F.col("outcome"), F.lit('"')]
    if version == 2:
        ends += [F.lit(',"certainty":"'), F.col("certainty"), F.lit('"')]
    return _assembled(c, info, piece, head, F.concat(*ends, F.lit("}")), ",", "json", limit)


def _changes_html(changes: Column) -> Column:
    span = lambda x: F.concat(F.lit('<span class="'), x["kind"], F.lit('">'), html_escape(x["text"]), F.lit("</span>"))
    return F.array_join(F.transform(changes, span), "")


def row_html(rows: DataFrame) -> Column:
    """One escaped, script-free fragment per row."""
    label = lambda s: location_label(F.col(f"{s}_kind"), F.col(f"{s}_idx"), F.coalesce(F.col(f"{s}_table_index"), F.lit(0)), F.coalesce(F.col(f"{s}_row_index"), F.lit(0)))
    only = lambda s, other: F.transform(F.filter("cell_changes", lambda c: c[f"{other}_cell"].isNull()), lambda c: c[f"{s}_cell"])

    def cells(s: str, other: str, word: str) -> Column:
        alone = only(s, other)
        one = lambda c, i: F.concat(
            F.lit("<li><b>"),
            F.when(F.array_contains(alone, i), F.concat(F.lit(f"{word}, {s} position "), (i + 1).cast("string"))).otherwise(F.concat(F.lit("Cell "), (i + 1).cast("string"))),
            F.lit("</b> "),
            html_escape(F.when(F.trim(c) == "", F.lit("Empty cell")).otherwise(c)),
            F.lit("</li>"),
        )
        listed = F.concat(F.lit(f"<ul class='{s}'>"), F.array_join(F.transform(f"{s}_cells", one), ""), F.lit("</ul>"))
        return F.when(F.col(f"{s}_cells").isNotNull(), listed).otherwise("")

    image = lambda c, alt: F.when(image_url(F.col(c)).isNotNull(), F.concat(F.lit(f'<img alt="{alt}" src="'), F.col(c), F.lit('">'))).otherwise("") if c in rows.columns else F.lit("")
    visual = F.lit("")
    if "changed_pixels" in rows.columns:
        share = F.format_number(100 * F.col("changed_pixels") / F.col("total_pixels"), 2)
        visual = F.when(F.col("changed_pixels").isNotNull(), F.concat(F.lit("<p>"), F.col("changed_pixels").cast("string"), F.lit(" of "), F.col("total_pixels").cast("string"), F.lit(" pixels changed ("), share, F.lit("%).</p>"), image("overlay", "Differences"))).otherwise("")
    counted = F.when(F.coalesce(changed_cells(F.col("cell_changes")), F.lit(0)) > 0, F.concat(F.lit("<p>"), changed_cells(F.col("cell_changes")).cast("string"), F.lit(" changed cells</p>"))).otherwise("")
    return F.concat(
        F.lit('<article><h2>'), F.col("status"), F.lit("</h2><p>"), label("before"), F.lit(" → "), label("after"), F.lit("</p><p>before: "), F.coalesce("before_evidence", F.lit("none")),
        F.lit(", after: "), F.coalesce("after_evidence", F.lit("none")), F.lit("</p>"), image("before_image", "Before"), F.lit("<pre>"), html_escape(F.coalesce("before_text", F.lit(""))), F.lit("</pre>"),
        cells("before", "after", "Removed"), image("after_image", "After"), F.lit("<pre>"), html_escape(F.coalesce("after_text", F.lit(""))), F.lit("</pre>"), cells("after", "before", "Added"), counted,
        F.lit("<div>"), _changes_html(F.col("changes")), F.lit("</div>"), visual, F.lit("</article>"),
    )


def html_report(c: Comparison, info: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """pair_id, html, html_bytes, error: one self-contained page per pair."""
    headline = F.when(F.col("outcome") == "identical", "No differences").when(F.col("outcome") == "uncertain", "To be reviewed: the evidence is incomplete").otherwise("Differences")
    side = lambda s: F.concat(html_escape(display_name(F.col(f"{s}_name"))), F.lit(" <small>"), html_escape(F.col(f"{s}_sha256")), F.lit("</small>, "), F.col(f"{s}_units").cast("string"), F.lit(" units"))
    counts = F.concat_ws(", ", *[F.concat_ws(" ", F.col(s).cast("string"), F.lit(s)) for s in STATUSES])
    notes = F.when(F.size("warnings") > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("<li>"), html_escape(w), F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise("")
    head = F.concat(F.lit(f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Comparison</title><style>{STYLE}</style></head><body><h1>'), headline, F.lit("</h1><p>Before: "), side("before"), F.lit("</p><p>After: "), side("after"), F.lit("</p><p>"), counts, F.lit("</p>"), notes)
    return _assembled(c, info, row_html(c.rows), head, F.lit("</body></html>"), "", "html", limit)


def preflight(c: Comparison, options: Options | None = None, info: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """pair_id, fits: whether both formats stay within the limit."""
    j, h = json_report(c, options, info, limit=limit), html_report(c, info, limit=limit)
    return j.select("pair_id", F.col("error").alias("e1")).join(h.select("pair_id", F.col("error").alias("e2")), "pair_id").select("pair_id", (F.col("e1").isNull() & F.col("e2").isNull()).alias("fits"))


def save_reports(reports: DataFrame, column: str, path: str) -> None:
    """One file per partition and report a line; the committer makes the write atomic."""
    reports.where(F.col(column).isNotNull()).select(F.col(column)).write.text(path)
