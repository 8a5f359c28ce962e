"""Text, cell and row differences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import omit_lines
from palimpsest.schema import CELL_CHANGE, CHANGE, Options

_PIECE = re.compile(r"\s+|\w+|[^\w\s]")


def edit_script(a: list, b: list) -> list[tuple[str, int, int]]:
    """Shortest edit script by furthest-reaching paths: (equal, i, j), (removed, i, -), (added, -, j) in order."""
    n, m = len(a), len(b)
    reach, history = {1: 0}, []
    for d in range(n + m + 1):
        history.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _walk_back(history, n, m, d)
    return []


def _walk_back(history: list[dict], x: int, y: int, d: int) -> list[tuple[str, int, int]]:
    out = []
    for step in range(d, -1, -1):
        reach, k = history[step], x - y
        if step == 0:
            px = py = 0
        else:
            down = k == -step or (k != step and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            pk = k + 1 if down else k - 1
            px, py = reach[pk], reach[pk] - pk
        while x > px and y > py:
            x, y = x - 1, y - 1
            out.append(("equal", x, y))
        if step:
            out.append(("added", -1, y - 1) if x == px else ("removed", x - 1, -1))
        x, y = px, py
    return out[::-1]


def text_changes(before: str, after: str, ignore_whitespace: bool = False) -> list[dict]:
    """Spans (kind, text): words, runs of white space and single signs are compared; removed before added.

    With ``ignore_whitespace`` any two runs of white space are equal, and a run that only one side
    has is no change; equal spans show the after side.
    """
    a, b = _PIECE.findall(before), _PIECE.findall(after)
    same = (lambda p: " " if p.isspace() else p) if ignore_whitespace else (lambda p: p)
    ka, kb = [same(p) for p in a], [same(p) for p in b]
    head = 0
    while head < min(len(a), len(b)) and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    spans: list[list[str]] = []
    held: dict[str, list[str]] = {"removed": [], "added": []}

    def flush():
        for kind in ("removed", "added"):
            text = "".join(held[kind])
            held[kind].clear()
            if text:
                put("equal" if ignore_whitespace and text.isspace() else kind, "" if ignore_whitespace and text.isspace() and kind == "removed" else text)

    def put(kind: str, text: str):
        if spans and spans[-1][0] == kind:
            spans[-1][1] += text
        elif text:
            spans.append([kind, text])

    put("equal", "".join(b[:head]))
    for kind, i, j in edit_script(ka[head : len(a) - tail], kb[head : len(b) - tail]):
        if kind == "equal":
            flush()
            put("equal", b[head + j])
        else:
            held[kind].append(a[head + i] if kind == "removed" else b[head + j])
    flush()
    put("equal", "".join(b[len(b) - tail :]))
    return [{"kind": k, "text": t} for k, t in spans]


def changes_udf(ignore_whitespace: bool):
    """Column function (before, after) -> array of changes."""

    @F.pandas_udf(f"array<{CHANGE}>")
    def changes(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([text_changes(x, y, ignore_whitespace) for x, y in zip(before, after, strict=True)])

    return changes


def single_change(text: Column, kind: str) -> Column:
    """The whole text as one change; none for an empty one."""
    none = F.array().cast(f"array<{CHANGE}>")
    return F.when(text != "", F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))).otherwise(none)


def equal_span(text: Column) -> Column:
    return single_change(text, "equal")


def any_change(changes: Column) -> Column:
    return F.exists(changes, lambda c: c["kind"] != "equal")


def cell_pairs(before: Column, after: Column) -> Column:
    """Cells by position, to the longer side: array of (before_cell, after_cell, before, after), null where missing."""
    pair = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    zipped = F.zip_with(F.coalesce(before, F.array().cast("array<string>")), F.coalesce(after, F.array().cast("array<string>")), pair)
    return F.transform(
        zipped,
        lambda c, i: F.struct(F.when(c["before"].isNotNull(), i).alias("before_cell"), F.when(c["after"].isNotNull(), i).alias("after_cell"), c["before"].alias("before"), c["after"].alias("after")),
    )


def cells_udf(options: Options):
    """Column function (before cells, after cells) -> array of cell changes."""

    def trim(text: str) -> str:
        lines = text.split("\n")
        start = min(options.ignore_header_lines, len(lines))
        return "\n".join(lines[start : max(start, len(lines) - options.ignore_footer_lines)])

    def one(i: int, left: list, right: list) -> dict:
        x, y = left[i] if i < len(left) else None, right[i] if i < len(right) else None
        if x is None or y is None:
            text, kind = (y, "added") if x is None else (x, "removed")
            found = [{"kind": kind, "text": text}] if text else []
        else:
            found = text_changes(trim(x), trim(y), options.ignore_whitespace)
        shown = x if x is not None else y
        return {"before_cell": None if x is None else i, "after_cell": None if y is None else i, "changes": found or [{"kind": "equal", "text": shown}]}

    @F.pandas_udf(f"array<{CELL_CHANGE}>")
    def cells(before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(before, after, strict=True):
            x, y = [] if x is None else list(x), [] if y is None else list(y)
            out.append([one(i, x, y) for i in range(max(len(x), len(y)))])
        return pd.Series(out)

    return cells


def cell_changed(cells: Column) -> Column:
    """Any cell that only one side has, or whose text changed."""
    return F.exists(cells, lambda c: c["before_cell"].isNull() | c["after_cell"].isNull() | any_change(c["changes"]))


def changed_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c["before_cell"].isNull() | c["after_cell"].isNull() | any_change(c["changes"])))


def compare_rows(aligned: DataFrame, units: DataFrame, options: Options, prefix: str = "block") -> DataFrame:
    """Aligned rows with both sides, changes, cell changes and status.

    Only rows whose texts differ reach Python; equal, one-sided and empty ones are settled by
    expressions.  Trimmed lines count for the diff; the rows keep the whole texts.
    """
    columns = ["kind", "table_index", "row_index", "text", "cells"]
    for side in ("before", "after"):
        own = units.where(F.col("side") == side).select("pair_id", F.col("unit_index").alias(f"{side}_idx"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        aligned = aligned.join(own, ["pair_id", f"{side}_idx"], "left")
    left, right = F.col("before_idx").isNotNull(), F.col("after_idx").isNotNull()
    trim = lambda c: omit_lines(F.col(c), options.ignore_header_lines, options.ignore_footer_lines)
    rows = aligned.withColumns({"_b": trim("before_text"), "_a": trim("after_text")})
    both = left & right
    differ = both & (F.col("_b") != F.col("_a"))
    has_cells = F.col("before_cells").isNotNull() | F.col("after_cells").isNotNull()
    told = rows.where(differ | has_cells).withColumn("changes", changes_udf(options.ignore_whitespace)(F.coalesce("_b", F.lit("")), F.coalesce("_a", F.lit(""))))
    told = told.withColumn("cell_changes", cells_udf(options)("before_cells", "after_cells")).withColumn("cell_changes", F.when(has_cells, F.col("cell_changes")))
    rest = rows.where(~F.coalesce(differ | has_cells, F.lit(False))).withColumn("changes", equal_span(F.col("_a"))).withColumn("cell_changes", F.lit(None).cast(f"array<{CELL_CHANGE}>"))
    rows = told.unionByName(rest)
    changes = F.when(both, F.col("changes")).when(left, single_change(F.col("before_text"), "removed")).otherwise(single_change(F.col("after_text"), "added"))
    rows = rows.withColumn("changes", changes)
    changed = any_change(F.col("changes")) | F.coalesce(cell_changed(F.col("cell_changes")), F.lit(False))
    status = F.when(~left, "added").when(~right, "removed").when(changed, "changed").otherwise("unchanged")
    return rows.withColumns({"status": status, "row_id": F.concat(F.lit(f"{prefix}-"), F.col("row_seq").cast("string"))}).drop("_a", "_b")
