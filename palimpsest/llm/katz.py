"""LM scoring: a Katz back-off bigram model with Good-Turing discounts.

P(w | h) is the discounted count c*(h, w) / c(h) where h w occurs in training, else a(h) P(w); a(h) makes
the sum over all words exactly one.  P(w) is the discounted unigram, whose freed mass belongs to one class
of unknown words.  Counts up to K get Good-Turing's discount; larger ones lose RESERVE of a count, so
that a history whose followers are all frequent can back off too.

Evaluation follows the recursion.  Postings (word, history, document, times) go to buckets of words,
where counts of words and bigrams are complete: a seen bigram is settled there, an unseen one becomes
an event for its history's bucket, which knows a(h).  Discounts depend on the whole corpus, so the
buckets count tokens by their (small) counts, and the logarithms of discounts are multiplied in at the
end: one pass over the texts does for counts and scores.  Tables in the shared folder, by kind: ``gram``
(per history and bucket the sums that its back-off weight needs), ``event``, ``part`` (sums by document),
``weight`` (history, count, log10 weight) and ``docs``.

A word that makes up over 1/SPLIT of a sample is split by its histories; its count is then taken
in a scan of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, mix64, release, shared_path, word_hashes
from palimpsest.llm.tokenize import slices

K = 5
RESERVE = 0.05
SLICE_CHARS, SLICE_DOCS = 3_000_000, 30_000
#: Postings of a bucket; a bucket is sorted in one task's memory.
BUCKET_TOKENS, LEAST_BUCKETS = 1_500_000, 16
SAMPLE_DOCS, SPLIT = 2000, 256
START, END = np.uint64(0x5354415254000000), np.uint64(0x454E440000000000)
ROW_SCHEMA = "kind string, key long, block long, data binary, f array<long>"
_ARROW = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("f", pa.list_(pa.int64()))])
OUT_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    """Remainder 1; a null id counts as training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each compressed by itself."""
    out = []
    for a in arrays:
        raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())
        out.append(struct.pack("<2sI", a.dtype.str[1:].encode(), len(raw)) + raw)
    return b"".join(out)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<2sI", data, at)
        at += 6
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + n]), "<" + kind.decode()))
        at += n
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least width."""
    most = int(a.max(initial=0))
    return a.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _runs(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _bucket_of(w: np.ndarray, h: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(np.isin(w, hot), mix64(w ^ mix64(h)), w) if len(hot) else w
    return (mix64(key) % np.uint64(buckets)).astype(np.int64)


def _postings(hot: np.ndarray, buckets: int):
    """Texts to one row per slice and bucket, and one per slice with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                for a in range(a, b, SLICE_DOCS):
                    yield _batch(list(_slice_rows(task << 24 | number, ids[a : min(b, a + SLICE_DOCS)], texts[a : min(b, a + SLICE_DOCS)], hot, buckets)))
                    number += 1

    return run


def _slice_rows(block: int, ids: list, texts: list, hot: np.ndarray, buckets: int) -> Iterator[tuple]:
    words = [word_hashes(t) for t in texts]
    n = np.array([len(w) + 1 for w in words])
    held = np.array([held_out(i) for i in ids])
    ends = np.cumsum(n)
    w = np.empty(ends[-1], np.uint64)
    h = np.empty(ends[-1], np.uint64)
    for x, e, k in zip(words, ends, n, strict=True):
        w[e - k : e - 1] = x
        w[e - 1] = END
        h[e - k] = START
        h[e - k + 1 : e] = x
    h >>= np.uint64(16)
    d = np.repeat(np.arange(len(ids)) << 1 | held, n)
    bucket = _bucket_of(w, h, hot, buckets)
    order = np.lexsort((d, h, w, bucket))
    w, h, d, bucket = w[order], h[order], d[order], bucket[order]
    new_w = np.append(True, (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1]))
    new_h = new_w | np.append(True, h[1:] != h[:-1])
    new_d = new_h | np.append(True, d[1:] != d[:-1])
    at_d = np.flatnonzero(new_d)
    times = _runs(at_d, len(w))
    for a, b in zip(*_bounds(bucket[at_d]), strict=True):
        p = at_d[a:b]  # postings of one bucket
        e = np.flatnonzero(new_h[p])  # of them, first of each bigram
        u = np.flatnonzero(new_w[p[e]])  # of these, first of each word
        data = pack_arrays(w[p[e[u]]], narrow(_runs(u, len(e))), h[p[e]].view(np.uint8).reshape(-1, 8)[:, :6].ravel(), narrow(_runs(e, len(p))), d[p].astype("<u2"), narrow(times[a:b]))
        yield "post", int(bucket[p[0]]), block, data, None
    blank = np.array([i is None for i in ids])
    yield "docs", block % buckets, block, pack_arrays(np.array([i or 0 for i in ids], "<i8"), blank.astype("u1"), held.astype("u1"), narrow(n)), None


def _bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.empty(0, int)
    return begin, np.append(begin[1:], len(sorted_values)).astype(int)


#: Columns of a document's part: two sums, known words, seen bigrams of count 1..K, unseen ones with words of count 0..K and above.
PART = 3 + K + K + 2


def _count(hot: np.ndarray, hot_counts: np.ndarray, buckets: int):
    """One bucket of words: counts, settled tokens, events, and what the histories' weights need."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        posts = []
        for kind, key, block, data in zip(*[table.column(c).to_pylist() for c in ("kind", "key", "block", "data")], strict=True):
            if kind == "docs":
                rows.append(("docs", block, block, data, None))
            else:
                posts.append((block, data))
        del table
        if posts:
            rows += _count_rows([b for b, _ in posts], [unpack_arrays(x) for _, x in posts], hot, hot_counts, buckets)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _count_rows(blocks: list[int], posts: list[list[np.ndarray]], hot: np.ndarray, hot_counts: np.ndarray, buckets: int) -> list[tuple]:
    rows = []
    w = np.concatenate([np.repeat(p[0], p[1]) for p in posts])
    per = np.concatenate([p[3].astype(np.int64) for p in posts])
    h = np.zeros((len(w), 8), np.uint8)
    h[:, :6] = np.concatenate([p[2] for p in posts]).reshape(-1, 6)
    h = h.view("<u8").ravel()
    d = np.concatenate([p[4].astype(np.int64) for p in posts])
    times = np.concatenate([p[5].astype(np.int64) for p in posts])
    blk = np.repeat(np.arange(len(posts)), [len(p[4]) for p in posts])
    del posts
    held = (d & 1).astype(bool)
    first = np.cumsum(per) - per
    train = np.add.reduceat(np.where(held, 0, times), first)  # of each bigram of a slice
    pair, inv = np.unique(mix64(w + np.uint64(0x9E3779B97F4A7C15)) ^ mix64(h), return_inverse=True)
    r_all = np.bincount(inv, train, len(pair)).astype(np.int64)
    r = r_all[inv]
    del pair
    word, winv = np.unique(w, return_inverse=True)
    c_all = np.bincount(winv, train, len(word)).astype(np.int64)
    n_train = int(c_all.sum())
    cold = np.ones(len(word), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
        cold = hot[at] != word
        c_all = np.where(cold, c_all, hot_counts[at])
    c = c_all[winv]
    own = c_all[cold]
    small = lambda x: [int((x == k).sum()) for k in range(1, K + 2)]
    rows.append(("freq", 0, 0, None, [n_train, int((own > 0).sum()), *small(own), *small(r_all)]))
    # what a history's weight needs, from each distinct bigram once
    one = np.full(len(r_all), -1)
    one[inv[::-1]] = np.arange(len(inv))[::-1]
    one = one[r_all > 0]
    rows += _gram_rows(h[one], r[one], c[one], buckets)
    # tokens
    R, C, W = np.repeat(r, per), np.repeat(c, per), np.repeat(w == END, per)
    doc = blk << 16 | d >> 1
    ids, at = np.unique(doc, return_inverse=True)
    total = lambda x: np.bincount(at, x, len(ids))
    log = np.log10
    base = total(times * log(C + 0.5))
    settled = np.where(R > K, log(np.maximum(R - RESERVE, 1e-9)), 0.0) + np.where((R == 0) & (C > K), log(np.maximum(C, 1)), 0.0) - np.where((C > 0) & ~W, log(np.maximum(C, 1)), 0.0)
    cols = [base, total(times * settled), narrow(total(times * (C > 0)).astype(np.int64))]
    cols += [narrow(total(times * (R == k)).astype(np.int64)) for k in range(1, K + 1)]
    cols += [narrow(total(times * ((R == 0) & (C == k))).astype(np.int64)) for k in range(K + 1)]
    cols.append(narrow(total(times * ((R == 0) & (C > K))).astype(np.int64)))
    for a, b in zip(*_bounds(ids >> 16), strict=True):
        rows.append(("part", blocks[ids[a] >> 16], blocks[ids[a] >> 16], pack_arrays((ids[a:b] & 0xFFFF).astype("<u2"), *[x[a:b] for x in cols]), None))
    # unseen bigrams ask their history
    ask = np.flatnonzero(R == 0)
    hh = np.repeat(h, per)[ask]
    bucket = (mix64(hh) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc[ask], hh, bucket))
    ask, hh, bucket = ask[order], hh[order], bucket[order]
    names = np.array(blocks, "<i8")
    for a, b in zip(*_bounds(bucket), strict=True):
        p = ask[a:b]
        rows.append(("event", int(bucket[a]), 0, pack_arrays(names, hh[a:b], narrow(blk[p]), (d[p] >> 1).astype("<u2"), narrow(times[p])), None))
    return rows


def _gram_rows(h: np.ndarray, r: np.ndarray, c: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Sums by history: count, bigrams of count 1..K and above, words of count 1..K, sum of larger words' counts."""
    bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    h, r, c, bucket = h[order], r[order], c[order], bucket[order]
    if not len(h):
        return
    first, _ = _bounds(h)
    sums = [np.add.reduceat(x.astype(np.int64), first) for x in (r, *[r == k for k in range(1, K + 1)], r > K, *[c == k for k in range(1, K + 1)], np.where(c > K, c, 0))]
    h, bucket = h[first], bucket[first]
    for a, b in zip(*_bounds(bucket), strict=True):
        yield "gram", int(bucket[a]), 0, pack_arrays(h[a:b], *[narrow(s[a:b]) for s in sums]), None


class Discounts:
    """Discounted counts c* of 1..K, and what of the unigram model depends on the whole corpus."""

    def __init__(self, freq: list[int]):
        self.tokens, self.types = freq[0], freq[1]
        self.uni, self.bi = self._good_turing(freq[2 : 3 + K]), self._good_turing(freq[3 + K :])
        freed = sum(n * (k - s) for k, (n, s) in enumerate(zip(freq[2:], self.uni, strict=False), 1))
        # without mass for unknown words, they get one count
        self.scale = 1.0 if freed > 0 or not self.tokens else self.tokens / (self.tokens + 1)
        self.unknown = 1.0 if not self.tokens else freed / self.tokens if freed > 0 else 1 / (self.tokens + 1)

    @staticmethod
    def _good_turing(n: list[int]) -> list[float]:
        """c* of counts 1..K from the numbers of types with counts 1..K+1; absolute discounting where those give none."""
        if all(n):
            cut = (K + 1) * n[K] / n[0]
            stars = [((k + 1) * n[k] / n[k - 1] - k * cut) / (1 - cut) if cut < 1 else -1 for k in range(1, K + 1)]
            if all(0 < s < k for k, s in enumerate(stars, 1)):
                return stars
        d = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [k - d for k in range(1, K + 1)]

    def word(self, c: int) -> float:
        """P of a word with training count c."""
        return self.unknown if c == 0 else self.scale * (self.uni[c - 1] if c <= K else c) / self.tokens

    def weights(self, sums: list[np.ndarray]) -> np.ndarray:
        """log10 of the back-off weights of histories, from the sums of their bigrams."""
        c, big = sums[0], sums[K + 1]
        freed = sum((k - self.bi[k - 1]) * sums[k] for k in range(1, K + 1)) + RESERVE * big
        seen = sum(self.uni[k - 1] * sums[K + 1 + k] for k in range(1, K + 1)) + sums[2 * K + 2]
        left = np.maximum(1 - self.scale * seen / max(self.tokens, 1), 1e-15)
        return np.log10(freed / c / left)


def _settle(discounts: Discounts):
    """One bucket of histories: weights, and the events' share of their documents' scores."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        key = table.column("key")[0].as_py()
        grams = [unpack_arrays(x) for k, x in zip(kinds, data, strict=True) if k == "gram"]
        events = [unpack_arrays(x) for k, x in zip(kinds, data, strict=True) if k == "event"]
        h, c, weight = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
        if grams:
            h, inv = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
            sums = [np.bincount(inv, np.concatenate([g[i] for g in grams]), len(h)) for i in range(1, 2 * K + 4)]
            c, weight = sums[0], discounts.weights(sums)
            rows.append(("weight", key, key, pack_arrays(h, narrow(c.astype(np.int64)), weight), None))
            start = np.searchsorted(h, START >> np.uint64(16))
            if start < len(h) and h[start] == START >> np.uint64(16):
                rows.append(("start", 0, 0, None, [int(c[start])]))
        found: dict[int, list] = {}
        for names, hh, blk, d, times in events:
            add = np.zeros(len(hh))
            if len(h):
                at = np.minimum(np.searchsorted(h, hh), len(h) - 1)
                add = np.where(h[at] == hh, (np.log10(np.maximum(c[at], 1)) + weight[at]) * times, 0.0)
            doc = blk.astype(np.int64) << 16 | d
            ids, at = np.unique(doc, return_inverse=True)
            total = np.bincount(at, add, len(ids))
            for a, b in zip(*_bounds(ids >> 16), strict=True):
                found.setdefault(int(names[ids[a] >> 16]), []).append((ids[a:b] & 0xFFFF, total[a:b]))
        for block, parts in found.items():
            ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            rows.append(("share", block, block, pack_arrays(ids.astype("<u2"), np.bincount(at, np.concatenate([p[1] for p in parts]), len(ids))), None))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _finish(discounts: Discounts, starts: int):
    """One slice of documents: their sums to scores."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(k, unpack_arrays(x)) for k, x in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True)]
        ids, blank, held, n = next(x for k, x in rows if k == "docs")
        sums = np.zeros((PART, len(ids)))
        share = np.zeros(len(ids))
        for kind, x in rows:
            if kind == "part":
                for i, col in enumerate(x[1:]):
                    sums[i, x[0]] += col
            elif kind == "share":
                share[x[0]] += x[1]
        n = n.astype(np.int64)
        base = sums[0] - n * log10(discounts.tokens + 0.5 * (discounts.types + 1))
        score = sums[1] + share - (log10(starts) if starts else 0.0)
        for k in range(1, K + 1):
            score += sums[2 + k] * log10(discounts.bi[k - 1])
        for k in range(K + 1):
            score += sums[3 + K + k] * log10(discounts.word(k) if k == 0 or discounts.tokens else 1)
        score += sums[4 + 2 * K] * log10(discounts.scale / max(discounts.tokens, 1))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=blank.astype(bool)),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": pa.array(n),
                "n_known": pa.array(sums[2].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), discounts.tokens)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    return run


def _totals(words: np.ndarray):
    """Counts of ``words`` in training documents and of all tokens, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tokens = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                h = word_hashes(text.as_py())
                tokens += len(h) + 1
                if len(words) and not held_out(doc_id.as_py()):
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    counts += np.bincount(at[words[at] == h], minlength=len(words))
                    counts[words == END] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words) + 1), pa.int32()), pa.array([*counts.tolist(), tokens], pa.int64())], names=["i", "n"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            w, n = np.unique(np.append(word_hashes(text.as_py()), END), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view("<i8")), pa.array(n, pa.int64())], names=["w", "n"])


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the words that make up over 1/SPLIT of a sample of about SAMPLE_DOCS documents; only where rows go depends on them."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "sample-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * SPLIT > total).select("w").collect()  # SPLIT words at most
    return np.sort(np.array([r["w"] for r in found], "<i8").view(np.uint64))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents that aren't held out and score them all: OUT_SCHEMA.

    Words are runs of anything but x20 and x09-x0D, A-Z lower-cased; each text ends with an end
    token.  Null texts are empty (the end token alone); a null id is training; repeated rows count
    and are scored each.  Without training documents every score is 0.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hot = frequent_words(docs)
    totals = docs.mapInArrow(_totals(hot), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # a row a frequent word
    totals = {r["i"]: r["n"] for r in totals}
    hot_counts = np.array([totals.get(i, 0) for i in range(len(hot))], np.int64)
    buckets = max(LEAST_BUCKETS, ceil(totals.get(len(hot), 0) / BUCKET_TOKENS))
    path = shared_path(spark, "katz")
    counted = docs.mapInArrow(_postings(hot, buckets), ROW_SCHEMA).groupBy("key").applyInArrow(_count(hot, hot_counts, buckets), ROW_SCHEMA)
    counted.write.partitionBy("kind").parquet(f"{path}/counts")
    release(spark)
    read = lambda name: spark.read.schema(ROW_SCHEMA).parquet(f"{path}/{name}")
    width = 2 + 2 * (K + 1)
    row = read("counts").where("kind = 'freq'").agg(*[F.sum(F.get("f", F.lit(i))) for i in range(width)]).first()
    freq = [x or 0 for x in row]
    freq[1] += int((hot_counts > 0).sum())
    for k in range(1, K + 2):
        freq[1 + k] += int((hot_counts == k).sum())
    discounts = Discounts(freq)
    settled = read("counts").where("kind in ('gram', 'event')").groupBy("key").applyInArrow(_settle(discounts), ROW_SCHEMA)
    settled.write.partitionBy("kind").parquet(f"{path}/settled")
    release(spark)
    start = read("settled").where("kind = 'start'").agg(F.sum(F.get("f", F.lit(0)))).first()[0] or 0
    parts = read("counts").where("kind in ('part', 'docs')").union(read("settled").where("kind = 'share'"))
    return parts.groupBy("key").applyInArrow(_finish(discounts, start), OUT_SCHEMA)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
