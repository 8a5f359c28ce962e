"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item's sketch is the SKETCH shingles of least hash.  A document with at least THRESHOLD of an
item's shingles holds most of the sketch too, however long the document is, so the search looks
the document's shingles up among the sketches' (asymmetric MinHash containment).  Items are
partitioned by size: up to SKETCH shingles the sketch is the whole item and the needed hits are
exact; beyond, the needed hits leave a true match out with a chance under MISS.  Every candidate is
verified on the full shingle sets.

Items are queries: they go to the executors in blocks of at most BLOCK_SHINGLES shingles, each
block against all documents, so nothing that is sent grows with either table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, shingle_hashes, word_hashes

WIDTH = 5
THRESHOLD = 0.8
SKETCH = 16
MISS = 1e-6
BLOCK_SHINGLES = 500_000


def hits_needed(n: int, threshold: float = THRESHOLD) -> int:
    """Sketch hits that a document must show for an item of ``n`` shingles to be verified."""
    if n <= SKETCH:
        return max(1, ceil(threshold * n - 1e-9))
    tail, m = 0.0, 0
    while True:  # the sketch is drawn without replacement, so the binomial tail is an upper bound
        tail += comb(SKETCH, m) * threshold**m * (1 - threshold) ** (SKETCH - m)
        if tail > MISS:
            return max(1, m)
        m += 1


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item_id, text in zip(pdf["item_id"], pdf["text"], strict=True):
            h = word_hashes(text)
            grams = np.unique(shingle_hashes(h, WIDTH))
            if len(grams):
                rows.append((item_id, min(WIDTH, len(h)), len(grams), grams.tobytes()))
        yield pd.DataFrame(rows, columns=["item_id", "width", "n", "grams"])


class Matcher:
    """A block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int | None, int, bytes]], threshold: float):
        self.ids = [i for i, _, _ in items]
        self.grams = [np.frombuffer(g, np.uint64) for _, _, g in items]
        self.widths = sorted({w for _, w, _ in items})
        self.least = [max(1, ceil(threshold * len(g) - 1e-9)) for g in self.grams]
        self.hits = np.array([hits_needed(len(g), threshold) for g in self.grams])
        keys = np.concatenate([g[:SKETCH] for g in self.grams])  # sorted: the least hashes
        owner = np.repeat(np.arange(len(items)), [min(SKETCH, len(g)) for g in self.grams])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)  # cheap first look by 20 bits
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item index, shared shingles) of the items that the text contains."""
        h = word_hashes(text)
        out = []
        if not len(h):
            return out
        all_grams = [shingle_hashes(h, w) for w in self.widths if w <= len(h)]
        if not all_grams:
            return out
        grams = all_grams[0] if len(all_grams) == 1 else np.concatenate(all_grams)
        near = np.unique(grams[self.seen[(grams >> np.uint64(44)).astype(np.int64)]])
        lo, hi = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
        owners = [self.owner[a:b] for a, b in zip(lo, hi, strict=True) if b > a]
        if not owners:
            return out
        items, counts = np.unique(np.concatenate(owners), return_counts=True)
        items = items[counts >= self.hits[items]]
        if len(items):
            full = np.unique(grams)
            for i in items.tolist():
                own = self.grams[i]
                at = np.minimum(np.searchsorted(full, own), len(full) - 1)
                shared = int((full[at] == own).sum())
                if shared >= self.least[i]:
                    out.append((i, shared))
        return out


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items' shingles, a bounded block at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInPandas(_item_rows, "item_id long, width int, n int, grams binary")
    rows = materialize(rows.withColumn("salt", F.xxhash64("item_id", "grams")), "items")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, ceil(total / BLOCK_SHINGLES))
    for k in range(parts if total else 0):
        yield [(r["item_id"], r["width"], bytes(r["grams"])) for r in rows.where(F.pmod("salt", F.lit(parts)) == k).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with n_shared >= threshold * n_item.

    Shingles are WIDTH words, A-Z lower-cased; an item of fewer words is one shingle of its own
    width.  Null or empty texts on either side match nothing.  Null ids stay null.  Rows repeated
    on either side match each.  Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    found = []
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, threshold))
        found.append(rows.mapInArrow(_search(shared), "doc_id long, item_id long, n_item int, n_shared int"))
    if not found:
        out = spark.createDataFrame([], "doc_id long, item_id long, n_item int, n_shared int")
    else:
        out = reduce(DataFrame.union, found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    """The block's matcher, built once in each Python process."""
    name, block, threshold = shared.value
    if name not in _MATCHERS:
        if len(_MATCHERS) > 3:
            _MATCHERS.clear()
        _MATCHERS[name] = Matcher(block, threshold)
    return _MATCHERS[name]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(shared)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for i, n in m.find(text.as_py()):
                    out.append((doc_id.as_py(), m.ids[i], len(m.grams[i]), n))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all columns and other rows stay as they are."""
    spark = docs.sparkSession
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, threshold))
        docs = docs.where(~_leaks(shared)(F.coalesce(F.col(text), F.lit(""))))
    return docs


def _leaks(shared):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        m = _matcher(shared)
        return pd.Series([bool(m.find(t)) for t in texts], dtype=bool)

    return leaks


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_leaks(read("documents"), read("benchmark"))


ORACLE = r"""
with iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from benchmark
), ig as (
  select distinct item_id, least(5, len(a)) as k, array_to_string(a[i:i + least(5, len(a)) - 1], ' ') as g
  from iw, unnest(range(1, len(a) - least(5, len(a)) + 2)) t(i) where len(a) > 0
), n as (select item_id, count(*) as n_item from ig group by 1),
dw as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents
), dg as (
  select distinct doc_id, k, array_to_string(a[i:i + k - 1], ' ') as g
  from dw, (select distinct k from ig) w, unnest(range(1, len(a) - k + 2)) t(i)
), s as (select doc_id, item_id, count(*) as n_shared from dg join ig using (k, g) group by 1, 2)
select doc_id, item_id, n_item::int as n_item, n_shared::int as n_shared, n_shared / n_item as containment
from s join n using (item_id) where 5 * n_shared >= 4 * n_item
"""
