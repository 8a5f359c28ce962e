"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.stage import materialize, shared_path

__all__ = ["materialize", "shared_path"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def running_start(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order`` (nulls first).

    The rows are dealt into sorted ranges and written once; only the total of each range meets
    in one place (one row a partition), so no task holds more than its own range.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    inner = inner.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(totals, "_range")
        .withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        .drop("_before")
    )


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that none of ``df``'s columns has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys with more than one in HEAVY of all rows are joined by broadcast: HEAVY of them at most.  ONE_TASK rows may meet in any case.
HEAVY, ONE_TASK = 1000, 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``groups``, one row a key, on ``key``; no task gathers a hot key's rows.

    ``groups.n`` is the number of rows that a key has at most; ``total`` their sum (or more), summed here if not given.
    The hot keys' groups go to all executors, and their number is bounded by HEAVY.
    """
    if total is None:
        total = groups.agg(F.sum("n")).first()[0] or 0
    if total <= ONE_TASK:
        return rows.join(groups, key)
    heavy = F.broadcast(groups.where(F.col("n") * HEAVY > total))
    hot = rows.join(heavy, key)
    return hot.unionByName(rows.join(heavy.select(key), key, "left_anti").join(groups.where(F.col("n") * HEAVY <= total), key))


#: perhaps_among has a bitmap of BITS_A_KEY for each key, in pieces of PIECE bits, of MOST_BITS (32 MB) at most.
BITS_A_KEY, PIECE, MOST_BITS = 16, 1 << 15, 1 << 28


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is one of ``keys``, a written table, and about one in BITS_A_KEY of the others: for a join to come.

    A bitmap of the keys' hashes goes to all executors, so that most rows which the join would drop aren't moved for
    it.  With more keys than fit its bound, more of the others stay; none of the keys' rows ever goes.
    """
    bits = PIECE
    while bits < min(BITS_A_KEY * keys.count(), MOST_BITS):
        bits *= 2
    piece, byte, found = fresh_names(rows, "piece", "byte", "found")
    at = F.xxhash64(key).bitwiseAND(F.lit(bits - 1).cast("long"))
    there = F.shiftrightunsigned(at, PIECE.bit_length() - 1)
    place = at.bitwiseAND(F.lit(PIECE - 1).cast("long"))
    maps = keys.select(there.alias(piece), place.alias(byte)).groupBy(piece).agg(F.bitmap_construct_agg(byte).alias(found))
    met = rows.withColumn(piece, there).join(F.broadcast(maps), piece)
    one = F.conv(F.hex(F.substring(found, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(one, place.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1).select(*rows.columns)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (node, component): a component is its smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` of longs to ``(node, component)``, the smallest node.

    As soon as at most ``one_task`` edges are left, one task unites them in Python; with 0, none does.

    Alternates large-star and small-star steps; each writes its edges in the shared folder.  A
    group's smallest neighbour comes from an aggregate with partial sums and goes back to a node
    of very many edges by broadcast, so such a node is never gathered in one task.  Nodes without an
    edge are not returned.
    """
    cur = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cur = materialize(cur, "edges")
    mark = _edge_mark(cur)
    while mark[0] > one_task:
        both = cur.union(cur.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: each larger neighbour of u points at u's smallest neighbour
        large = join_groups(both.where("v > u"), least, "u", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, floor, "u", mark[0])
        small = small.select(F.col("v").alias("u"), "m").union(floor.select("u", "m")).where("u <> m").distinct()
        cur = materialize(small.select(F.col("m").alias("a"), F.col("u").alias("b")), "edges")
        now = _edge_mark(cur)
        if now == mark:
            break
        mark = now
    if 0 < mark[0] <= one_task:
        return materialize(cur.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    out = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return out.union(cur.select(F.col("a"), F.col("a")).distinct())


def _edge_mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first()
    return tuple(row)


def pairs_within(rows: DataFrame, key: str, columns: list[str], condition: Callable[[str, str], Column], block: int = 1000) -> DataFrame:
    """Every pair of ``rows`` (id, columns, members) of one key that meets ``condition``, once each: columns x and y, structs.

    ``members`` says how many rows the key has.  A large key is dealt in blocks of about ``block``
    rows, each of which meets itself and each other in a group of its own, so no task holds a key.
    """
    parts = F.greatest(F.ceil(F.col("members") / block), F.lit(1)).cast("int")
    me = F.struct(*columns)
    rows = rows.select(key, "members", me.alias("me"), F.pmod(F.xxhash64(columns[0]), parts).cast("int").alias("own"))
    left = rows.select(key, F.col("me").alias("x"), F.col("own").alias("p"), F.explode(F.sequence(F.col("own"), parts - 1)).alias("q"))
    right = rows.select(key, F.col("me").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p"), F.col("own").alias("q"))
    left, right = left.alias("l"), right.alias("r").hint("merge")
    same = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.p") == F.col("r.p")) & (F.col("l.q") == F.col("r.q"))
    once = (F.col("l.p") < F.col("l.q")) | (F.col(f"x.{columns[0]}") < F.col(f"y.{columns[0]}"))
    return left.join(right, same & once & condition("x", "y")).select("x", "y")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased.  bytes.split() cuts at x20 and x09-x0D only."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, in order; a shorter text is one shingle; no words, none."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, np.uint64(width * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for i in range(width):
        out = mix64(out + h[i : i + n])
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, before the next step writes its own."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
