"""Exact moves, summaries and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import fingerprint, move_id, omit_lines
from palimpsest.operators.diff import equal_span
from palimpsest.schema import STATUSES, Options

#: Warnings that tell of a step left out without need: the evidence stays complete.
HARMLESS = "OCR_SKIPPED"


def row_units(rows: DataFrame) -> DataFrame:
    """The units of both sides as the rows show them, after any OCR: one row a unit, with its row_seq and whether it stands alone."""

    def unit(side: str, other: str) -> Column:
        text = F.coalesce(F.col(f"{side}_text"), F.lit(""))
        parts = {"side": F.lit(side), "unit_index": F.col(f"{side}_idx"), "kind": F.col(f"{side}_kind"), "text": text, "cells": F.col(f"{side}_cells"), "alone": F.col(f"{other}_idx").isNull()}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    both = rows.select("pair_id", "row_seq", F.inline(F.array(unit("before", "after"), unit("after", "before"))))
    return both.where("unit_index is not null")


def exact_moves(units: DataFrame) -> DataFrame:
    """pair_id, print, before_seq, from_idx, after_seq, to_idx: units alone in their rows whose fingerprint stands once on each side.

    ``units`` are row_units; fingerprints count over whole documents, so a text that recurs never moves.
    """
    told = units.select("pair_id", "side", F.when(F.col("alone"), F.struct("row_seq", "unit_index")).alias("at"), fingerprint(F.col("kind"), F.col("text"), F.col("cells")).alias("print"))
    side = lambda s: F.col("side") == s
    places = [F.max(F.when(side(s), F.col("at"))).alias(s) for s in ("before", "after")]
    found = told.groupBy("pair_id", "print").agg(F.count_if(side("before")).alias("nb"), F.count_if(side("after")).alias("na"), *places)
    found = found.where("nb = 1 and na = 1 and before is not null and after is not null")
    return found.select("pair_id", "print", F.col("before.row_seq").alias("before_seq"), F.col("before.unit_index").alias("from_idx"), F.col("after.row_seq").alias("after_seq"), F.col("after.unit_index").alias("to_idx"))


def reclassify_moves(rows: DataFrame, options: Options | None = None) -> DataFrame:
    """Exact moves as one row each, at the added row's place, named by the move; the removed row goes.

    A moved row has both sides, whose texts and cells are equal, so its changes and cell changes
    are equal spans (of the text without omitted lines).
    """
    options = options or Options()
    moves = exact_moves(row_units(rows))
    carried = [c for c in rows.columns if c.startswith("before_")]
    old = rows.select("pair_id", F.col("row_seq").alias("before_seq"), F.struct(*carried).alias("_old"))
    named = moves.select("pair_id", "before_seq", "after_seq", move_id(F.col("print"), F.col("from_idx"), F.col("to_idx")).alias("move_id")).join(old, ["pair_id", "before_seq"])
    # one row for each place a move touches: the removed row's goes, the added row's is filled
    gone = F.struct(F.col("before_seq").alias("row_seq"), F.lit(None).cast("string").alias("move_id"), F.lit(None).cast(old.schema["_old"].dataType).alias("_old"), F.lit(True).alias("_goes"))
    filled = F.struct(F.col("after_seq").alias("row_seq"), "move_id", "_old", F.lit(False).alias("_goes"))
    touched = named.select("pair_id", F.inline(F.array(gone, filled)))
    out = rows.drop("move_id").join(touched, ["pair_id", "row_seq"], "left").where("_goes is null or not _goes")
    moved = F.col("move_id").isNotNull()
    trim = lambda c: omit_lines(c, options.ignore_header_lines, options.ignore_footer_lines)
    shown = lambda c: F.array(F.struct(F.lit("equal").alias("kind"), F.coalesce(F.nullif(trim(c), F.lit("")), c).alias("text")))
    cells = F.transform("after_cells", lambda c, i: F.struct(i.alias("before_cell"), i.alias("after_cell"), shown(c).alias("changes")))
    fresh = {c: F.col(f"_old.{c}") for c in carried}
    fresh |= {"status": F.lit("moved"), "row_id": F.col("move_id"), "changes": equal_span(trim(F.col("after_text"))), "cell_changes": cells}
    return out.withColumns({c: F.when(moved, x).otherwise(F.col(c)) for c, x in fresh.items()}).drop("_old", "_goes")


def outcome(differences: Column, complete: Column) -> Column:
    """Any difference: changed; else identical if the evidence is complete."""
    return F.when(differences, "changed").when(complete, "identical").otherwise("uncertain")


def summarize(rows: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row per pair: counts by status, warnings (distinct, in order), certainty, outcome, first changed row."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    out = rows.groupBy("pair_id").agg(*counts, F.min(F.when(F.col("status") != "unchanged", F.col("row_seq"))).alias("first_change"))
    if warnings is not None:
        out = out.join(warnings.select("pair_id", F.array_distinct("warnings").alias("warnings")), "pair_id", "left")
        out = out.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    else:
        out = out.withColumn("warnings", F.array().cast("array<string>"))
    complete = F.forall("warnings", lambda w: w.startswith(HARMLESS))
    differences = F.col("changed") + F.col("added") + F.col("removed") + F.col("moved") > 0
    return out.withColumns({"certainty": F.when(complete, "complete").otherwise("incomplete"), "outcome": outcome(differences, complete)})
