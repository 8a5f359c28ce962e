"""Suffix-array dedup: find every byte that lies in a string of LENGTH bytes that also starts elsewhere.

A suffix array over all bytes would move each byte LENGTH times, so suffixes start at anchors.
The anchor of a window of LENGTH bytes is its SEED-byte string of least hash: equal windows have equal
anchors at equal places, and an anchor serves a run of windows.

1. Every anchor sends the hash of its seed and that of all the bytes of its windows.  A seed found once
   settles its windows as unique; windows whose bytes are all equal settle as repeated, and
   one of them stands for them all.
2. Only anchors whose seed recurs with other bytes around it go on, with those bytes.  Their suffixes
   (from the anchor on) are dealt by sampled splitters into ranges of leading bytes.
3. A range's suffixes are sorted by multikey quicksort, eight bytes at a time; common prefixes of
   neighbours give, for every reach to the right, the groups of equal suffixes, and a hash of the
   bytes to the left tells which windows within a group are equal.
4. A group that a splitter cuts may have members in the next range: windows whose right part the
   splitter starts with are compared across the boundary, by their hashes, in one aggregate.

A text that recurs within a task is sent once, so copies make no hot seed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import mix64, release, shared_path
from palimpsest.llm.katz import narrow, pack_arrays, unpack_arrays

LENGTH, SEED = 200, 64
SPAN = LENGTH - SEED + 1
SLICE = 2_000_000
#: Anchors of a bucket in step 1, bytes of a range in step 3: each is held in one task.
BUCKET_BYTES = 16_000_000
RANGE_BYTES = 12_000_000
#: Runs whose bytes go out at once; repeated windows of a range that are held before they are joined.
RECORDS, WINDOWS = 20_000, 500_000

_rng = np.random.default_rng(99)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0x9FB21C651E98DF25
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:  # doubling: the next stretch is this one times base**done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        step = step * step
        done += take
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            _POWERS.clear()
            _POWERS[size] = _powers(_BASE, size), _powers(_UNBASE, size)
    return _POWERS[size]


class Hasher:
    """Hashes of any substrings of a byte array, by sums of its bytes' values times powers."""

    def __init__(self, data: np.ndarray):
        self.powers, inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * inverse[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.powers[begin])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of ``length`` bytes, as ``of`` gives them."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.powers[: len(out)]
        return mix64(out)


def anchors(data: np.ndarray, bounds: np.ndarray, sent: np.ndarray):
    """Runs of windows with one anchor, and repeats within a document.

    ``bounds``: where documents begin, and the end; ``sent``: which documents take part.  Returns
    (doc, anchor, first, last, seed hash, bytes hash) of the runs, places within ``data``, and
    (doc, place) of windows that recur in their own document.
    """
    n, none = len(data), np.empty(0, np.int64)
    if n < LENGTH:
        return (none,) * 6, (none, none)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    windows = n - LENGTH + 1
    valid = (doc[:windows] == doc[LENGTH - 1 :]) & sent[doc[:windows]]
    h = Hasher(data)
    seeds = h.every(SEED)
    least, width = seeds & np.uint64(0xFFFFFFFFFF000000), 1  # least hash, then leftmost
    least |= np.arange(len(seeds), dtype=np.uint64)
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[SPAN - width : SPAN - width + windows])
    least &= np.uint64(0xFFFFFF)
    anchor = least.astype(np.int32)
    del least

    def runs():
        p = np.flatnonzero(valid)
        if not len(p):
            return none, none, none
        new = np.append(True, (anchor[p[1:]] != anchor[p[:-1]]) | (p[1:] != p[:-1] + 1) | (doc[p[1:]] != doc[p[:-1]]))
        begin = np.flatnonzero(new)
        return anchor[p[begin]].astype(np.int64), p[begin], p[np.append(begin[1:], len(p)) - 1]

    a, first, last = runs()
    twice = none
    if len(a):
        # documents in which a seed recurs: their own repeats are settled here
        order = np.lexsort((seeds[a], doc[a]))
        same = (doc[a][order][1:] == doc[a][order][:-1]) & (seeds[a][order][1:] == seeds[a][order][:-1])
        some = np.unique(doc[a][order][1:][same])
        if len(some):
            p = np.flatnonzero(valid & np.isin(doc[:windows], some))
            w = h.of(p, p + LENGTH)
            order = np.lexsort((p, w, doc[p]))
            eq = (doc[p][order][1:] == doc[p][order][:-1]) & (w[order][1:] == w[order][:-1])
            later, earlier = np.append(False, eq), np.append(eq, False)
            twice = p[order[later | earlier]]
            valid[p[order[later]]] = False
            a, first, last = runs()
    content = mix64(h.of(first, last + LENGTH) ^ mix64((a - first).astype(np.uint64) << np.uint64(16) | (a - last).astype(np.uint64)))
    return (doc[a], a, first, last, seeds[a], content), (doc[twice], twice)


def _merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals: sorted, maximal runs."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


_ROW = "bucket int, data binary, rid long, begin int, end int"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("rid", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])


def _send(buckets: int):
    """Texts to one row per slice and bucket, and rows of what is settled within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int] | None] = {}
        turn = 0
        for batch in batches:
            rids, texts = batch.column(0).to_pylist(), batch.column(1)
            begin, held = 0, []
            size = 0
            for i in range(batch.num_rows + 1):
                raw = (texts[i].as_py() or "").encode("utf-8", "surrogatepass") if i < batch.num_rows else b""
                if held and (i == batch.num_rows or size + len(raw) > SLICE):
                    yield _slice(rids[begin:i], held, seen, buckets, turn)
                    turn += 1
                    begin, held, size = i, [], 0
                held.append(raw)
                size += len(raw)

    return run


def _slice(rids: list[int], texts: list[bytes], seen: dict, buckets: int, turn: int) -> pa.RecordBatch:
    import xxhash

    settled: list[tuple[int, int, int]] = []
    sent = np.zeros(len(texts), bool)
    if len(seen) > 500_000:
        seen.clear()
    for i, raw in enumerate(texts):
        if len(raw) < LENGTH:
            continue
        name = xxhash.xxh3_128_digest(raw)
        sent[i] = name not in seen
        if sent[i]:
            seen[name] = (rids[i], len(raw))
        else:
            settled.append((rids[i], 0, len(raw)))
            if seen[name]:  # the first copy is a copy too
                settled.append((seen[name][0], 0, seen[name][1]))
                seen[name] = None
    used = [r if s else b"" for r, s in zip(texts, sent, strict=True)]
    rows = []
    # a document longer than a slice is cut into overlapping parts: its arrays take some 70 bytes a byte
    for group in _groups(used, SLICE):
        data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
        bounds = np.cumsum([0, *[len(part) for _, _, part in group]])
        (doc, a, first, last, seed, content), (tdoc, tat) = anchors(data, bounds, np.ones(len(group), bool))
        index = np.array([i for i, _, _ in group])
        offset = np.array([o for _, o, _ in group]) - bounds[:-1]
        for d in np.unique(tdoc):
            p = tat[tdoc == d] + offset[d]
            settled += [(rids[index[d]], int(x), int(y)) for x, y in zip(*_merge(np.sort(p), np.sort(p) + LENGTH), strict=True)]
        bucket = (mix64(seed) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((seed, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ids = np.array([rids[i] for i in index], "<i8")
        for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
            o = order[x:y]
            place = (first[o] + offset[doc[o]]).astype(np.int64)
            used_docs, which = np.unique(doc[o], return_inverse=True)
            rows.append((int(bucket[o[0]]), pack_arrays(ids[used_docs], narrow(which), seed[o], content[o], narrow(place), narrow(a[o] - first[o]), narrow(last[o] - first[o])), None, None, None))
    rows += [((turn + k) % buckets, None, r, b, e) for k, (r, b, e) in enumerate(settled)]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def _groups(texts: list[bytes], limit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts (number, offset, bytes) in groups of under ``limit`` bytes; longer ones in parts that overlap by LENGTH - 1."""
    group, size = [], 0
    for i, raw in enumerate(texts):
        step = limit - LENGTH
        parts = [(i, 0, raw)] if len(raw) <= step else [(i, o, raw[o : o + step]) for o in range(0, len(raw) - LENGTH + 1, step - LENGTH + 1)]
        for part in parts:
            if group and size + len(part[2]) > limit:
                yield group
                group, size = [], 0
            if len(part[2]) >= LENGTH:
                group.append(part)
                size += len(part[2])
    if group:
        yield group


_FOUND = "kind string, rid long, begin int, end int, anchor int"


def _found(kind: list[str], rid: list, begin: list, end: list, anchor: list) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.string()), "rid": pa.array(rid, pa.int64()), "begin": pa.array(begin, pa.int32()), "end": pa.array(end, pa.int32()), "anchor": pa.array(anchor, pa.int32())})


def _match(table: pa.Table) -> pa.Table:
    """One bucket of seeds: repeated runs, and the runs whose bytes must be compared."""
    settled = table.filter(pa.compute.is_valid(table.column("rid")))
    posts = [unpack_arrays(x) for x in table.column("data").to_pylist() if x is not None]
    out = [_found(["cover"] * len(settled), settled.column("rid").combine_chunks(), settled.column("begin").combine_chunks(), settled.column("end").combine_chunks(), [0] * len(settled))]
    if posts:
        rid = np.concatenate([p[0][p[1]] for p in posts])
        seed, content = np.concatenate([p[2] for p in posts]), np.concatenate([p[3] for p in posts])
        place, left, more = (np.concatenate([p[i].astype(np.int64) for p in posts]) for i in (4, 5, 6))
        _, which, one, times = _unique(mix64(seed) ^ content)
        seeds, of = np.unique(seed[one], return_inverse=True)
        others = np.bincount(of, minlength=len(seeds))[of] > 1
        full = times[which] > 1
        b, e, r = place[full], place[full] + more[full] + LENGTH, rid[full]
        order = np.lexsort((b, r))
        b, e, r = b[order], e[order], r[order]
        out.append(_found(["cover"] * len(r), r, b, e, np.zeros(len(r), int)))
        need = one[others]
        out.append(_found(["need"] * len(need), rid[need], place[need], place[need] + more[need], place[need] + left[need]))
    return pa.concat_tables(out)


def _unique(x: np.ndarray):
    u, first, inv, n = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    return u, inv, first, n


_RECORD = pa.schema([("rid", pa.int64()), ("anchor", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("suffix", pa.binary()), ("left", pa.binary()), ("range", pa.int32())])
_RECORD_ROW = "rid long, anchor int, first int, last int, suffix binary, left binary, range int"


def _records(splitters: list[bytes]):
    """The bytes of the runs to compare: from the anchor on, and those before it backwards; and the number of the suffix's range.

    A row's repeats within the task add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            ends, needs = batch.column(2).offsets.to_pylist(), batch.column(2).values
            begin, end, anchor = (needs.field(c).to_numpy() for c in ("begin", "end", "anchor"))
            for i, (rid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if rid in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(rid)
                raw = text.as_py().encode("utf-8", "surrogatepass")
                own = slice(ends[i], ends[i + 1])
                for first, last, a in zip(begin[own].tolist(), end[own].tolist(), anchor[own].tolist(), strict=True):
                    suffix = raw[a : last + LENGTH]
                    out.append((rid, a, first, last, suffix, raw[first:a][::-1], bisect_right(splitters, suffix.ljust(LENGTH, b"\0"))))
                    if len(out) == RECORDS:
                        yield _record_batch(out)
                        out = []
            if out:
                yield _record_batch(out)

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (big-endian words of strings): three-way partition by one word, then by the next."""
    out, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            out.append(rows)
        elif len(rows) <= 256:
            out.append(rows[np.lexsort(words[rows][:, :depth - 1 if depth else None :-1].T)] if len(rows) > 1 else rows)
        else:
            v = words[rows, depth]
            pivot = np.sort(v[:: max(1, len(v) // 9)])[len(v[:: max(1, len(v) // 9)]) // 2]
            todo += [(rows[v > pivot], depth), (rows[v == pivot], depth + 1), (rows[v < pivot], depth)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes of the rows of two byte matrices."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


_RESOLVED = "kind string, rid long, begin int, end int, key long"


def _resolve(splitters: list[bytes]):
    """One range of suffixes: windows that recur in it, and those to compare across its boundaries."""

    def run(table: pa.Table) -> pa.Table:
        at = table.column("range")[0].as_py()
        rid, anchor, first, last = (table.column(c).to_numpy() for c in ("rid", "anchor", "first", "last"))
        suffix = _matrix(table.column("suffix").to_pylist(), LENGTH)
        left = _matrix(table.column("left").to_pylist(), SPAN - 1)
        del table
        order = multikey_sort(np.ascontiguousarray(suffix).view(">u8").astype(np.uint64))
        rid, anchor, first, last, suffix, left = (x[order] for x in (rid, anchor, first, last, suffix, left))
        least, most = anchor - last, anchor - first  # bytes of a window before its anchor
        common = np.append(0, _common(suffix[1:], suffix[:-1])) if len(suffix) else np.empty(0)
        edge = np.zeros(len(rid), np.int64)
        for s in splitters[max(0, at - 1) : at + 1]:
            edge = np.maximum(edge, _common(suffix, np.broadcast_to(np.frombuffer(s, np.uint8), suffix.shape)))
        before = np.zeros(len(rid), np.uint64)
        covers, edges, held = [], [], 0
        # hashes of the right parts, for windows that may go on across a boundary
        rights: dict[int, np.ndarray] = {}
        rim = np.flatnonzero(edge >= SEED)
        if len(rim):
            right = np.zeros(len(rim), np.uint64)
            for t in range(LENGTH):
                right = mix64(right + _TABLE[suffix[rim, t]])
                if t + 1 >= SEED:
                    rights[t + 1] = right
        del suffix
        for d in range(SPAN):
            if d:
                before = mix64(before + _TABLE[left[:, d - 1]])
            reach = LENGTH - d
            on = np.flatnonzero((least <= d) & (d <= most))
            if not len(on):
                continue
            group = np.cumsum(common < reach)[on]
            key = mix64(before[on] ^ mix64(group.astype(np.uint64)))
            _, which, _, times = _unique(key)
            hit = on[times[which] > 1]
            covers.append((rid[hit], anchor[hit] - d, anchor[hit] - d + LENGTH))
            held += len(hit)
            if held > WINDOWS:
                covers, held = [_joined(covers)], 0
            cut = on[edge[on] >= reach]
            if len(cut):
                edges.append((rid[cut], anchor[cut] - d, mix64(before[cut] ^ mix64(rights[reach][np.searchsorted(rim, cut)] + np.uint64(d)))))
        r, b, e = _joined(covers)
        kind, key = ["cover"] * len(r), np.zeros(len(r), np.int64)
        if edges:
            er, eb, ek = (np.concatenate([x[i] for x in edges]) for i in range(3))
            kind += ["edge"] * len(er)
            r, b, e, key = np.append(r, er), np.append(b, eb), np.append(e, eb + LENGTH), np.append(key, ek.view(np.int64))
        return pa.table({"kind": pa.array(kind, pa.string()), "rid": pa.array(r, pa.int64()), "begin": pa.array(b, pa.int32()), "end": pa.array(e, pa.int32()), "key": pa.array(key, pa.int64())})

    return run


def _joined(covers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals by document: maximal runs."""
    r, b, e = (np.concatenate([np.empty(0, np.int64), *[c[i] for c in covers]]) for i in range(3))
    if not len(r):
        return r, b, e
    order = np.lexsort((b, r))
    r, b, e = r[order], b[order], e[order]
    high = np.cumsum(np.append(False, r[1:] != r[:-1])) << 32  # a document's places come after all of the one before
    reach = np.maximum.accumulate(high + e)
    new = np.flatnonzero(np.append(True, (high + b)[1:] > reach[:-1]))
    return r[new], b[new], reach[np.append(new[1:], len(r)) - 1] & 0xFFFFFFFF


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their covered bytes."""
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            lengths, spans, kept = [], [], []
            for text, covers in zip(part.column(1), part.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own = covers.as_py() or []
                b, e = _merge(np.array([c["begin"] for c in own], np.int64), np.array([c["end"] for c in own], np.int64))
                lengths.append(len(raw))
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(b, e, strict=True)])
                points = [0, *[int(v) for pair in zip(b, e, strict=True) for v in pair], len(raw)]
                kept.append(b"".join(raw[points[i] : points[i + 1]] for i in range(0, len(points), 2)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _gathered(covers: DataFrame) -> DataFrame:
    """Covers by number, equal ones once: rows repeated with the same id and text share a number, and each would get all rows' covers."""
    return covers.groupBy("rid").agg(F.collect_set(F.struct("begin", "end")).alias("covers"))


def _release(spark: SparkSession) -> None:
    """``release`` that reaches the step just ended: the listener bus holds its plan until another event comes."""
    spark.sql("SELECT 1").collect()
    release(spark)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (removed, maximal, ascending), kept (the other bytes).

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in this document
    or another; strings are judged on the input.  Null texts are empty; texts under LENGTH bytes
    stay whole.  Rows repeated with the same id and text are copies of each other and go
    whole if they are long enough.  Null ids stay null.  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    sent = docs.where(F.octet_length("text") >= LENGTH).select("rid", "text").mapInArrow(_send(buckets), _ROW)
    path = shared_path(spark, "repeats")
    sent.groupBy("bucket").applyInArrow(_match, _FOUND).write.parquet(f"{path}/found")
    _release(spark)
    found = spark.read.schema(_FOUND).parquet(f"{path}/found")
    covers = found.where("kind = 'cover'").select("rid", "begin", "end")
    needs = found.where("kind = 'need'")
    size, number = needs.agg(F.sum(F.col("end") - F.col("begin") + LENGTH), F.count(F.lit(1))).first()
    ranges = -(-(size or 0) // RANGE_BYTES)
    # sampled splitters: about 16 suffixes a range
    every = max(1, number // (16 * max(1, ranges)))
    picked = F.broadcast(needs.where(F.pmod(F.xxhash64("rid", "anchor"), F.lit(every)) == 0))
    suffix = F.substr(F.col("text").cast("binary"), F.col("anchor") + 1, F.col("end") + LENGTH - F.col("anchor"))
    sample = docs.join(picked, "rid").select("rid", "anchor", F.rpad(F.hex(suffix), 2 * LENGTH, "0").alias("s")).distinct().collect() if ranges > 1 else []
    sample = sorted(bytes.fromhex(r["s"]) for r in sample)
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    need = needs.groupBy("rid").agg(F.collect_list(F.struct("begin", "end", "anchor")).alias("need"))
    # here and at the end the few numbers of a document are hashed, so that no task sorts texts
    records = docs.join(need.hint("shuffle_hash"), "rid").select("rid", "text", "need").mapInArrow(_records(splitters), _RECORD_ROW)
    records.groupBy("range").applyInArrow(_resolve(splitters), _RESOLVED).write.parquet(f"{path}/resolved")
    _release(spark)
    resolved = spark.read.schema(_RESOLVED).parquet(f"{path}/resolved")
    edges = resolved.where("kind = 'edge'")
    both = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    covers = covers.union(resolved.where("kind = 'cover'").select("rid", "begin", "end")).union(edges.join(both, "key").select("rid", "begin", "end"))
    out = docs.join(_gathered(covers).hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "covers")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 200 bytes."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
