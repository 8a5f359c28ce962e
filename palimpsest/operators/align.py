"""Ordered alignment of two units sequences.

Relational part: units whose fingerprint is unique on both sides are anchors (an aggregate and an
equi-join).  What has no relational form runs once per pair of documents: the longest chain of anchors
in order, and between anchors a global alignment by similarity.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import fingerprint
from palimpsest.schema import ALIGNED

MIN_SIMILARITY = 0.25
PAIR_SCALE, PAIR_SHIFT, GAP = 6.0, 3.0, -0.75
#: Cells up to which a gap between anchors is aligned globally; beyond, greedily.
GLOBAL_CELLS = 200_000
LOOK_AHEAD = 16
_BLANK = re.compile(r"[\t\n\x0b\f\r﻿  ]")


def with_fingerprints(units: DataFrame) -> DataFrame:
    return units.withColumn("print", fingerprint(F.col("kind"), F.col("text"), F.col("cells")))


def print_counts(units: DataFrame) -> DataFrame:
    """pair_id, side, print, n, and the unit's index where n is 1."""
    return units.groupBy("pair_id", "side", "print").agg(F.count(F.lit(1)).alias("n"), F.min("unit_index").alias("unit_index"))


def unique_anchors(units: DataFrame) -> DataFrame:
    """pair_id, before_idx, after_idx of fingerprints that occur once on each side."""
    one = print_counts(units).where("n = 1")
    before = one.where("side = 'before'").select("pair_id", "print", F.col("unit_index").alias("before_idx"))
    after = one.where("side = 'after'").select("pair_id", "print", F.col("unit_index").alias("after_idx"))
    return before.join(after, ["pair_id", "print"]).select("pair_id", "before_idx", "after_idx")


def longest_chain(after: list[int]) -> list[int]:
    """Positions of a longest strictly increasing run of ``after``; of equals the one replaced last."""
    tails, at, previous = [], [], [-1] * len(after)
    for i, value in enumerate(after):
        k = bisect_left(tails, value)
        if k:
            previous[i] = at[k - 1]
        if k == len(tails):
            tails.append(value)
            at.append(i)
        else:
            tails[k], at[k] = value, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = previous[i]
    return chain[::-1]


def token_list(text: str) -> list[str]:
    out, run = [], []
    for ch in unicodedata.normalize("NFKC", text).lower():
        if unicodedata.category(ch)[0] in "LN":
            run.append(ch)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


def blank(text: str) -> bool:
    return all(unicodedata.category(ch)[0] == "Z" or _BLANK.match(ch) for ch in text)


def dice_matrix(left: list[Counter], right: list[Counter]) -> np.ndarray:
    """Dice of every pair of multisets, from the tokens that both sides have."""
    where: dict[str, tuple[list, list]] = {}
    for i, c in enumerate(left):
        for t, n in c.items():
            where.setdefault(t, ([], []))[0].append((i, n))
    for j, c in enumerate(right):
        for t, n in c.items():
            if t in where:
                where[t][1].append((j, n))
    shared = np.zeros((len(left), len(right)))
    for a, b in where.values():
        if b:
            (i, n), (j, m) = zip(*a, strict=True), zip(*b, strict=True)
            shared[np.ix_(i, j)] += np.minimum.outer(n, m)
    size = np.add.outer([c.total() for c in left], [c.total() for c in right])
    return np.where(size == 0, 1.0, 2 * shared / np.maximum(size, 1))


def sample_similarity(a, b) -> float:
    n, m = min(len(a), len(b)), max(len(a), len(b))
    if not n:
        return 0.0
    apart = np.abs(np.asarray(a[:n], float) - np.asarray(b[:n], float)).mean()
    return max(0.0, 1 - apart / 255 - 0.25 * (1 - n / m))


def similarity_matrix(left: list[str], right: list[str], left_samples: list, right_samples: list) -> np.ndarray:
    dice = dice_matrix([Counter(token_list(t)) for t in left], [Counter(token_list(t)) for t in right])
    visual = np.array([[sample_similarity(a, b) for b in right_samples] for a in left_samples]).reshape(dice.shape)
    no_left, no_right = np.array([blank(t) for t in left], bool), np.array([blank(t) for t in right], bool)
    both, one = np.logical_and.outer(no_left, no_right), np.logical_xor.outer(no_left, no_right)
    return np.where(both, visual, np.where(one, 0.9 * visual, np.minimum(1.0, 0.86 * dice + 0.14 * visual)))


def align_by_similarity(sim: np.ndarray) -> list[tuple[int | None, int | None]]:
    """Global alignment, filled by anti-diagonals; on ties a pair, then a unit of the before side alone, is taken."""
    n, m = sim.shape
    score = np.zeros((n + 1, m + 1))
    score[:, 0], score[0, :] = GAP * np.arange(n + 1), GAP * np.arange(m + 1)
    move = np.zeros((n + 1, m + 1), np.int8)  # 0 pair, 1 before alone, 2 after alone
    move[1:, 0], move[0, 1:] = 1, 2
    gain = np.where(sim >= MIN_SIMILARITY, PAIR_SCALE * sim - PAIR_SHIFT, -np.inf)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        options = np.stack([score[i - 1, j - 1] + gain[i - 1, j - 1], score[i - 1, j] + GAP, score[i, j - 1] + GAP])
        pick = options.argmax(axis=0)
        score[i, j], move[i, j] = options[pick, np.arange(len(i))], pick
    out, i, j = [], n, m
    while i or j:
        kind = move[i, j]
        out.append((i - 1 if kind != 2 else None, j - 1 if kind != 1 else None))
        i, j = i - (kind != 2), j - (kind != 1)
    return out[::-1]


class _Side:
    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("unit_index")
        self.kind, self.text, self.print = pdf["kind"].tolist(), pdf["text"].fillna("").tolist(), pdf["print"].tolist()
        self.sample = [[] if s is None else list(s) for s in pdf["sample"]]


def _fill(a: _Side, b: _Side, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int | None, int | None]]:
    """Alignment of the units between two anchors."""
    if i0 == i1 or j0 == j1:
        return [*((i, None) for i in range(i0, i1)), *((None, j) for j in range(j0, j1))]
    if (i1 - i0) * (j1 - j0) > GLOBAL_CELLS:
        return _greedy(a, b, i0, i1, j0, j1)
    empty = lambda texts: [[] if t else [0] for t in texts]  # noqa: E731  empty texts are alike
    left, right = a.text[i0:i1], b.text[j0:j1]
    out = []
    for i, j in align_by_similarity(similarity_matrix(left, right, empty(left), empty(right))):
        if i is not None and j is not None and a.kind[i0 + i] != b.kind[j0 + j]:
            out += [(i0 + i, None), (None, j0 + j)]
        else:
            out.append((None if i is None else i0 + i, None if j is None else j0 + j))
    return out


def _greedy(a: _Side, b: _Side, i: int, i1: int, j: int, j1: int) -> list[tuple[int | None, int | None]]:
    """Merge join with a bounded look ahead, for gaps too large to align globally."""
    out: list[tuple[int | None, int | None]] = []
    while i < i1 and j < j1:
        if a.print[i] != b.print[j]:
            ahead: dict[str, int] = {}
            for y in range(min(j1, j + LOOK_AHEAD) - 1, j - 1, -1):
                ahead[b.print[y]] = y
            meets = [(x - i + ahead[a.print[x]] - j, x) for x in range(i, min(i1, i + LOOK_AHEAD)) if a.print[x] in ahead]
            if not meets:
                alike = a.kind[i] == b.kind[j] and dice_matrix([Counter(token_list(a.text[i]))], [Counter(token_list(b.text[j]))])[0, 0] >= MIN_SIMILARITY
                out += [(i, j)] if alike else [(i, None), (None, j)]
                i, j = i + 1, j + 1
                continue
            _, x = min(meets)
            y = ahead[a.print[x]]
            out += [*((k, None) for k in range(i, x)), *((None, k) for k in range(j, y))]
            i, j = x, y
        out.append((i, j))
        i, j = i + 1, j + 1
    return [*out, *((k, None) for k in range(i, i1)), *((None, k) for k in range(j, j1))]


def _rows(key, pairs: list[tuple[int | None, int | None]]) -> pd.DataFrame:
    before = pd.array([p[0] for p in pairs], "Int32")
    after = pd.array([p[1] for p in pairs], "Int32")
    return pd.DataFrame({"pair_id": key[0], "row_seq": np.arange(1, len(pairs) + 1, dtype=np.int32), "before_idx": before, "after_idx": after})


def _align_blocks(key, before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    anchors = before.loc[before["anchor"].notna(), ["unit_index", "anchor"]].sort_values("unit_index").astype(int).to_numpy().tolist()
    a, b = _Side(before), _Side(after)
    kept = [anchors[k] for k in longest_chain([y for _, y in anchors])]
    out, i, j = [], 0, 0
    for x, y in [*kept, [len(a.text), len(b.text)]]:
        out += _fill(a, b, i, x, j, y)
        if x < len(a.text):
            out.append((x, y))
        i, j = x + 1, y + 1
    return _rows(key, out)


def _align_pages(key, before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    a, b = _Side(before), _Side(after)
    return _rows(key, align_by_similarity(similarity_matrix(a.text, b.text, a.sample, b.sample)))


def align(units: DataFrame, pages: bool = False) -> DataFrame:
    """Aligned rows (pair_id, row_seq from 1, before_idx, after_idx) of ``units`` (schema.UNIT).

    ``pages``: one global alignment by text and samples; else anchors first.  Unit indexes run
    from 0 without gaps on each side.  A pair's units are held by one task; schema.LIMITS bounds them.
    """
    units = with_fingerprints(units)
    if pages:
        units = units.withColumn("anchor", F.lit(None).cast("int"))
    else:
        anchors = unique_anchors(units).select("pair_id", F.lit("before").alias("side"), F.col("before_idx").alias("unit_index"), F.col("after_idx").alias("anchor"))
        units = units.join(anchors, ["pair_id", "side", "unit_index"], "left")
    columns = ["pair_id", "unit_index", "kind", "text", "print", "sample", "anchor"]
    # toDF gives each side columns of its own
    sides = [units.where(F.col("side") == s).select(columns).toDF(*columns).groupBy("pair_id") for s in ("before", "after")]
    return sides[0].cogroup(sides[1]).applyInPandas(_align_pages if pages else _align_blocks, ALIGNED)
