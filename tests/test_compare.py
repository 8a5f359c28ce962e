"""Alignment, differences, moves, summaries and reports."""

import json

import numpy as np
import pytest
from palimpsest.operators import align as al
from palimpsest.operators import diff, raster
from palimpsest.plans import batch, compare, reports
from palimpsest.schema import UNIT, CompareError, Options
from pyspark.sql import functions as F


def units(pairs):
    """{pair: (before, after)}; a unit is a text, or a list of cells."""
    rows = []
    for pair, sides in pairs.items():
        for side, texts in zip(("before", "after"), sides):
            for i, t in enumerate(texts):
                cells = t if isinstance(t, list) else None
                rows.append((pair, side, i, "table-row" if cells else "paragraph", 0 if cells else None, i if cells else None, "\t".join(cells) if cells else t, cells, None))
    return rows


def run(spark, pairs, **options):
    c = compare.compare_blocks(spark.createDataFrame(units(pairs), UNIT), Options(**options))
    rows = {}
    for r in c.rows.orderBy("pair_id", "row_seq").collect():
        rows.setdefault(r.pair_id, []).append(r)
    return c, rows, {r.pair_id: r for r in c.results.collect()}


def test_statuses(spark):
    c, rows, res = run(
        spark,
        {
            "change": (["delivery total 1250", ["a", "500"]], ["delivery total 1350", ["a", "600"]]),
            "insert": (["one first", "three last"], ["one first", "two middle", "three last"]),
            "move": (["Unique moved clause: account 742.", "second text", "third text"], ["second text", "third text", "Unique moved clause: account 742."]),
            "swap": (["X one", "Y two"], ["Y two", "X one"]),
            "repeat": (["A", "B", "B", "O"], ["A", "B", "O", "B"]),
            "same": (["a", "b", ""], ["a", "b", ""]),
            "cells": ([["a", "b"]], [["a", "b", ""]]),
            "kinds": (["same words here"], [["same words here"]]),
            "row": ([["x", "y"], "p one", "p two"], ["p one", "p two", ["x", "y"]]),
        },
    )
    got = {p: [(r.before_idx, r.after_idx, r.status) for r in rs] for p, rs in rows.items()}
    assert got["change"] == [(0, 0, "changed"), (1, 1, "changed")]
    assert [(c.kind, c.text) for c in rows["change"][0].changes] == [("equal", "delivery total "), ("removed", "1250"), ("added", "1350")]
    assert [c.before_cell for c in rows["change"][1].cell_changes if any(x.kind != "equal" for x in c.changes)] == [1]
    assert got["insert"] == [(0, 0, "unchanged"), (None, 1, "added"), (1, 2, "unchanged")]
    assert got["move"] == [(1, 0, "unchanged"), (2, 1, "unchanged"), (0, 2, "moved")]
    assert rows["move"][2].move_id == "move-7deebb54-0-2"
    assert got["swap"] == [(1, 0, "unchanged"), (0, 1, "moved")]
    assert res["repeat"].moved == 0
    assert res["same"].outcome == "identical" and res["same"].first_change is None
    assert got["cells"] == [(0, 0, "changed")] and rows["cells"][0].cell_changes[2].before_cell is None
    assert [s for *_, s in got["kinds"]] == ["removed", "added"]
    assert got["row"] == [(1, 0, "unchanged"), (2, 1, "unchanged"), (0, 2, "moved")]
    row = rows["row"][2]
    assert row.row_id == row.move_id and [(c.before_cell, c.after_cell, [tuple(x) for x in c.changes]) for c in row.cell_changes] == [(0, 0, [("equal", "x")]), (1, 1, [("equal", "y")])]
    assert res["move"].outcome == "changed" and res["insert"].first_change == 2
    for r in rows["change"]:
        assert r.row_id == f"block-{r.row_seq}"


def test_options(spark):
    pairs = {"p": (["a b\tc", "head\nbody"], ["a  b c", "HEAD\nbody"])}
    _, rows, res = run(spark, pairs, ignore_whitespace=True)
    assert rows["p"][0].status == "unchanged" and rows["p"][1].status == "changed"
    _, rows, res = run(spark, {"p": (["head\nbody"], ["HEAD\nbody"])}, ignore_header_lines=1)
    assert rows["p"][0].status == "unchanged" and res["p"].outcome == "identical"
    _, rows, _ = run(spark, {"m": (["x one", "y"], ["y", "x one"])}, detect_moves=False)
    assert [r.status for r in rows["m"]] == ["added", "unchanged", "removed"] or [r.status for r in rows["m"]] == ["removed", "unchanged", "added"]
    for bad in ({"ignore_header_lines": 101}, {"visual_threshold": 256}, {"ignore_whitespace": 1}, {"ocr_before_pages": [1, 1]}):
        with pytest.raises(CompareError):
            Options(**bad).check()


def test_one_sided_and_greedy(spark):
    many = [f"paragraph {i}" for i in range(500)]
    _, rows, res = run(spark, {"left": (["only before"], []), "right": ([], ["only after"]), "big": (many, [[t] for t in many])})
    assert [r.status for r in rows["left"]] == ["removed"] and [r.status for r in rows["right"]] == ["added"]
    assert (res["big"].removed, res["big"].added) == (500, 500)


def test_pages(spark):
    shade = lambda v: [v] * 64
    rows = [("p", "before", i, "page", None, None, t, None, shade(s)) for i, (t, s) in enumerate([("alpha beta", 200), ("gamma delta", 100), ("", 40)])]
    rows += [("p", "after", i, "page", None, None, t, None, shade(s)) for i, (t, s) in enumerate([("alpha beta", 200), ("new page entirely", 10), ("gamma delta", 100), ("", 40)])]
    c = compare.compare_pages(spark.createDataFrame(rows, UNIT))
    got = [(r.before_idx, r.after_idx, r.status) for r in c.rows.orderBy("row_seq").collect()]
    assert got == [(0, 0, "unchanged"), (None, 1, "added"), (1, 2, "unchanged"), (2, 3, "unchanged")]
    r = c.results.first()
    assert r.certainty == "incomplete" and r.outcome == "changed" and len(r.warnings) == 1


def test_longest_chain():
    assert al.longest_chain([1, 0]) == [1]
    assert al.longest_chain([]) == []
    rng = np.random.default_rng(1)
    for _ in range(50):
        values = rng.permutation(12).tolist()
        best = 0
        for mask in range(1 << 12):
            run_ = [values[i] for i in range(12) if mask >> i & 1]
            if all(x < y for x, y in zip(run_, run_[1:])):
                best = max(best, len(run_))
        chain = [values[i] for i in al.longest_chain(values)]
        assert len(chain) == best and chain == sorted(chain)


def test_alignment_is_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sim = rng.choice([0, 0.2, 0.25, 0.5, 0.86], (rng.integers(0, 5), rng.integers(0, 5)))

        def best(i, j, sim=sim):
            options = []
            if i and j and sim[i - 1, j - 1] >= 0.25:
                options.append(best(i - 1, j - 1) + 6 * sim[i - 1, j - 1] - 3)
            if i:
                options.append(best(i - 1, j) - 0.75)
            if j:
                options.append(best(i, j - 1) - 0.75)
            return max(options, default=0)

        pairs = al.align_by_similarity(sim)
        score = sum(-0.75 if None in p else 6 * sim[p] - 3 for p in pairs)
        assert score == pytest.approx(best(*sim.shape))


def test_text_changes_rebuild_both_sides():
    rng = np.random.default_rng(3)
    words = ["a", "b", "c", " ", "\n", ",", "12"]
    for _ in range(200):
        x, y = "".join(rng.choice(words, rng.integers(0, 12))), "".join(rng.choice(words, rng.integers(0, 12)))
        spans = diff.text_changes(x, y)
        assert "".join(s["text"] for s in spans if s["kind"] != "added") == x
        assert "".join(s["text"] for s in spans if s["kind"] != "removed") == y
        assert all(s["kind"] != t["kind"] for s, t in zip(spans, spans[1:]))
    assert all(s["kind"] == "equal" for s in diff.text_changes("a\t", "a", ignore_whitespace=True))


def test_reports(spark):
    bad = "<script>alert('x')</script> & \"q\""
    c, _, _ = run(spark, {"a-b": ([bad, ["1", " "]], [bad + " more", ["1", "2"]]), "c-d": (["s"], ["s"])})
    out = {r.pair_id: r for r in reports.json_report(c).collect()}
    parsed = json.loads(out["a-b"].json)
    assert parsed["schemaVersion"] == 2 and [r["status"] for r in parsed["rows"]] == ["changed", "changed"]
    assert parsed["rows"][0]["beforeText"] == bad and parsed["documents"]["before"]["unitCount"] == 2
    assert list(parsed) == ["schemaVersion", "documents", "options", "rows", "summary", "warnings", "outcome", "certainty"]
    assert json.loads(out["c-d"].json)["outcome"] == "identical"
    html = {r.pair_id: r.html for r in reports.html_report(c).collect()}["a-b"]
    assert "<script" not in html and "&lt;script&gt;" in html and "Empty cell" in html
    assert {r.error for r in reports.json_report(c, limit=300).collect()} == {"OUTPUT_LIMIT_EXCEEDED"}
    assert all(r.fits for r in reports.preflight(c).collect())


def test_batches(spark):
    schema = "batch_id string, seq int, job_id string, status string, before_name string, after_name string, json string, error struct<code:string,message:string>, result_bytes long"
    jobs = [("b", 1, "pair-1", "succeeded", "x/a.docx", "b", '{"k":1}', None, 60), ("b", 2, "pair-2", "failed", "a", "b\n", None, ("odd code", "m\ty"), 0), ("b", 3, "pair-3", "succeeded", "a", "b", '{"k":2}', None, 60), ("b", 4, "pair-4", "succeeded", "a", "b", "{}", None, 1)]
    df = spark.createDataFrame(jobs, schema)
    gated = {r.seq: (r.status, r.error and r.error.code) for r in batch.output_gate(df, 100).collect()}
    assert gated == {1: ("succeeded", None), 2: ("failed", "odd code"), 3: ("failed", "BATCH_OUTPUT_LIMIT"), 4: ("not-run", None)}
    r = batch.batch_report(df).first()
    parsed = json.loads(r.json)
    assert r.fault is None and r.fits and parsed["summary"] == {"succeeded": 3, "failed": 1, "cancelled": 0, "notRun": 0}
    assert parsed["jobs"][0] == {"id": "pair-1", "status": "succeeded", "beforeName": "a.docx", "afterName": "b", "result": {"k": 1}}
    assert parsed["jobs"][1]["error"] == {"code": "COMPARE_FAILED", "message": "m y"}
    for change in (("job_id", F.lit("pair-1")), ("status", F.lit("not-run")), ("status", F.lit("failed"))):
        assert batch.batch_report(df.withColumn(*change)).first().fault


def test_raster():
    white = np.full((2, 2, 4), 255, np.uint8)
    black = white.copy()
    black[0, 0, :3] = 0
    overlay, changed = raster.raster_diff(white, black, 24)
    assert changed == 1 and overlay[0, 0].tolist() == [220, 40, 72, 235] and overlay[1, 1, 3] == 0
    _, changed = raster.raster_diff(white, np.zeros((3, 2, 4), np.uint8), 254)
    assert changed == 6
    grey = white.copy()
    grey[..., :3] -= 24
    assert raster.raster_diff(white, grey, 24)[1] == 0 and raster.raster_diff(white, grey, 23)[1] == 4
    assert raster.signature(white) == [255] * 256
