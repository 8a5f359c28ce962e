"""Best-fit packing of documents into sequences of a fixed length: large-item matching.

Only lengths decide where a piece goes, and there are at most ``capacity`` of them, so the plan is
made on the histogram: pieces above one third of the capacity are matched greedily, the largest with
the largest that still fits (at most two share a sequence), then shorter ones fill the tightest gaps.
A plan is a list of patterns, each a list of lengths with the number of sequences that look so.  Every
piece then finds its slot from its rank among the pieces of its length; no piece moves for that.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize
from palimpsest.llm.tokenize import encoder, slices

CAPACITY = 2048
#: Rows of the table of ranks that may be sent to every executor (about 30 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of sequences, [(length, how many)]) that hold ``counts[length]`` pieces of each length."""
    left = {s: c for s, c in counts.items() if c}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("a piece is longer than a sequence, or empty")
    # gap -> patterns with that gap, each [number, [(length, how many)]]
    open_: dict[int, list] = {}
    gaps: list[int] = []  # sorted keys of open_

    def put(gap: int, number: int, items: list) -> None:
        if number:
            if gap not in open_:
                open_[gap] = []
                bisect.insort(gaps, gap)
            open_[gap].append([number, items])

    def take(gap: int, number: int):
        """Up to ``number`` sequences of one pattern with this gap."""
        stack = open_[gap]
        have = stack[-1]
        got = min(number, have[0])
        have[0] -= got
        if not have[0]:
            stack.pop()
            if not stack:
                del open_[gap]
                gaps.pop(bisect.bisect_left(gaps, gap))
        return got, have[1]

    large = sorted((s for s in left if 3 * s > capacity))
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:
            put(capacity - a, left.pop(a), [(a, 1)])
            large.pop()
            continue
        b = large[i]
        if a == b:
            pairs, odd = divmod(left.pop(a), 2)
            large.pop()
            put(capacity - 2 * a, pairs, [(a, 2)])
            if odd:  # one is over: it may pair with a smaller one
                left[a] = 1
                j = bisect.bisect_left(large, a) - 1
                if j >= 0:
                    c = large[j]
                    put(capacity - a - c, 1, [(a, 1), (c, 1)])
                    left[c] -= 1
                    if not left[c]:
                        del left[c]
                        large.pop(j)
                else:
                    put(capacity - a, 1, [(a, 1)])
                del left[a]
            continue
        pairs = min(left[a], left[b])
        put(capacity - a - b, pairs, [(a, 1), (b, 1)])
        for s in (a, b):
            left[s] -= pairs
            if not left[s]:
                del left[s]
                large.remove(s)
    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            i = bisect.bisect_left(gaps, s)
            gap = gaps[i] if i < len(gaps) else capacity
            each = gap // s
            if i == len(gaps):
                number, items = max(1, c // each), []
            else:
                number, items = take(gap, max(1, c // each))
            if c < each:  # the last sequence takes what is left
                each, number = c, 1
            put(gap - each * s, number, [*items, (s, each)])
            c -= each * number
    return [(number, items) for stack in open_.values() for number, items in stack]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Per pattern and length: the ranks of pieces it takes (from ``first``), its first sequence, and where they lie."""
    rows, rank, sequence = [], {}, 0
    for number, items in patterns:
        offset = 0
        for s, each in items:
            first = rank.get(s, 0)
            rows.append((s, first, each, sequence, offset))
            rank[s] = first + number * each
            offset += s * each
        sequence += number
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"])


def _pieces(tokenizer: str, end_id: int, capacity: int):
    schema = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("task_rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        step = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 2_000_000):
                out = []
                for row, raw in zip(at[a:b], enc.encode(texts[a:b]), strict=True):
                    raw += end
                    for k in range(0, len(raw), capacity * step):
                        ids = raw[k : k + capacity * step]
                        n = len(ids) // step
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        out.append((row, k // (capacity * step), k // step, n, ids, task, rank))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids (binary, little-endian), sequence_id, offset.

    A document's ids end with ``end_id``; only longer ones are cut, into pieces of ``capacity``.
    Null text is empty and packs as its end id; a null doc_id stays null; repeated rows pack each.
    An empty table gives an empty result.  Ties (pieces of equal length) go by the order of the
    input's partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("row"), F.col(text).alias("text"))
    cut = rows.mapInArrow(_pieces(tokenizer, end_id, capacity), "row long, piece int, start long, length long, ids binary, task long, task_rank long")
    cut = materialize(cut, "pieces")  # encoded once; ranks below refer to these rows
    ranks = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = materialize(ranks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n"), "ranks")
    # at most `capacity` lengths, whatever the input's size
    counts = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    by_length = {int(s): g[["first", "each", "sequence", "offset"]].to_numpy() for s, g in table.groupby("length")}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            t = by_length[int(lengths[at[0]])]
            r = ranks[at]
            i = np.searchsorted(t[:, 0], r, side="right") - 1
            nth, place_in = np.divmod(r - t[i, 0], t[i, 1])
            out[at, 0] = t[i, 2] + nth
            out[at, 1] = t[i, 3] + place_in * lengths[at[0]]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    base = ranks.select("length", "task", "base")
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = cut.join(base, ["length", "task"]).withColumn("at", place("length", F.col("base") + F.col("task_rank")))
    return placed.select(F.col("row").alias("doc_id"), "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def ids_crc32(id_bytes: int = 2):
    """Column function: CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{id_bytes}").astype("<u4").tobytes()) for x in ids], dtype="int64")

    return crc


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with word_bpe_49k.json in sequences of 2048."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", ids_crc32()("ids").alias("ids_crc32"), "sequence_id", "offset")
