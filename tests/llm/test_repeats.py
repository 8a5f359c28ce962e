"""Repeated strings against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from palimpsest.llm import repeats
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, rid string, bucket string"


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for p in range(len(r) - repeats.LENGTH + 1):
            w = r[p : p + repeats.LENGTH]
            count[w] = count.get(w, 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - repeats.LENGTH + 1):
            if count[r[p : p + repeats.LENGTH]] > 1:
                gone[p : p + repeats.LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(500)]
    make = lambda k: " ".join(rng.choices(words, k=k))
    passages = [make(rng.randint(25, 80)) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = [make(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts.append(p[cut : len(p) - rng.randint(0, len(p) // 3)] if rng.random() < 0.6 else p)
            parts.append(make(rng.randint(0, 20)))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "A A A " * 200, "x" * 500, "x" * 199, "short", None, "", "abc " * 60 + texts[5], texts[6][: len(texts[6]) // 2], make(3000), make(10) + "\0\0" * 150]
    base = make(200).split()
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("ranges", [10**9, 3000])
def test_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(repeats, "RANGE_BYTES", ranges)
    texts = corpus(1)
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(None, texts[9], None, None), (20, texts[20], None, "x")]
    want = brute([r[1] for r in rows])
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    flat = lambda rows: sorted(map(str, rows))
    assert flat((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in got) == flat((r[0], *w) for r, w in zip(rows, want))
    assert sum(bool(w[1]) for w in want) > 60


def test_long_texts_are_cut_with_overlap():
    rng = random.Random(1)
    text = bytes(rng.choices(b"abcdefgh ", k=5000))
    parts = [p for g in repeats._groups([text], 1000) for p in g]
    covered = {o + i for _, o, p in parts for i in range(len(p) - repeats.LENGTH + 1)}
    assert covered == set(range(len(text) - repeats.LENGTH + 1))


def letters(n, seed):
    return np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8).tobytes()


@pytest.mark.parametrize("text", [letters(9_000_000, 1), b"abcdefg hijkl " * 600_000])
def test_memory_of_a_long_text(text):
    repeats._power_tables(repeats.SLICE)
    tracemalloc.start()
    try:
        repeats._slice([1], [text], {}, 16, 0)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 400e6


def test_texts_longer_than_a_slice(spark):
    passage = letters(300, 2)
    text = bytearray(letters(2 * repeats.SLICE + 5000, 3))
    places = [1000, repeats.SLICE - repeats.LENGTH - 150, 2 * repeats.SLICE - 3000]
    for i, at in enumerate(places):
        text[at - 1 : at + 301] = b"%d%b%d" % (i, passage, i)
    rows = [(1, text.decode(), None, None), (2, f"A{passage.decode()}A", None, None)]
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [(p, p + 300) for p in places], 2: [(1, 301)]}


def test_records_go_out_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "RECORDS", 2)
    raw, other = letters(400, 4), letters(300, 5)
    need = [[{"begin": i, "end": i + 3, "anchor": i + 20} for i in range(5)], [], [{"begin": 7, "end": 9, "anchor": 9}]]
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("anchor", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([raw.decode(), "x", other.decode()]), pa.array(need, kind)], names=["rid", "text", "need"])
    splitters = sorted([raw[21:221], other[9:209]])
    out = list(repeats._records(splitters)(iter([batch, batch])))
    assert [b.num_rows for b in out] == [2, 2, 2]
    want = [(1, i + 20, i, i + 3, raw[i + 20 : i + 203], raw[i : i + 20][::-1]) for i in range(5)] + [(3, 9, 7, 9, other[9:209], other[7:9][::-1])]
    want = [(*w, sum(s <= w[4].ljust(repeats.LENGTH, b"\0") for s in splitters)) for w in want]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_windows_joined_as_they_come(monkeypatch):
    rng = random.Random(6)
    passage = letters(260, 7)
    rows = []
    for rid in range(300):
        text, a = letters(60, rid + 10) + passage[: rng.randint(200, 260)] + letters(200, rid + 500), rng.randint(60, 130)
        rows.append((rid, a, 40, 80 if a >= 80 else 50, text[a:][: repeats.LENGTH], text[40:a][::-1], 0))
    table = pa.Table.from_batches([repeats._record_batch(rows)])
    want = repeats._resolve([])(table).to_pylist()
    monkeypatch.setattr(repeats, "WINDOWS", 50)
    assert want and repeats._resolve([])(table).to_pylist() == want


def test_joined():
    rng = random.Random(8)
    rows = [(rng.choice([-5, 0, 1 << 60]), b, b + rng.randint(1, 40)) for b in [rng.randint(0, 900) for _ in range(60)]]
    want = []
    for r in sorted({r for r, _, _ in rows}):
        gone = np.zeros(1001, int)
        for _, b, e in (x for x in rows if x[0] == r):
            gone[b:e] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        want += [(r, int(b), int(e)) for b, e in zip(edges[::2], edges[1::2])]
    parts = [tuple(np.array(c) for c in zip(*rows[i : i + 20])) for i in range(0, 60, 20)]
    assert list(zip(*(x.tolist() for x in repeats._joined(parts)))) == want


def test_no_task_sorts_texts(spark):
    out = repeats.remove_repeats(spark.createDataFrame([(1, "x" * 300, None, None)], SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_repeated_rows_do_not_square(spark):
    covers = spark.createDataFrame([(1, 0, 300)] * 50 + [(1, 5, 400), (2, 0, 200)], "rid long, begin int, end int")
    assert {r.rid: sorted((c.begin, c.end) for c in r.covers) for r in repeats._gathered(covers).collect()} == {1: [(0, 300), (5, 400)], 2: [(0, 200)]}
    rows = [(7, "word " * 60, None, None)] * 500 + [(8, "word " * 60, None, None), (9, "other", None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans]) for r in got) == [(7, 300, [(0, 300)])] * 500 + [(8, 300, [(0, 300)]), (9, 5, [])]


def test_files_of_the_step_just_ended_go(spark):
    import os
    import time

    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    before = files()
    spark.range(1000).repartition(3, "id").groupBy(F.spark_partition_id()).count().write.format("noop").mode("overwrite").save()
    assert files() - before
    repeats._release(spark)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before


def test_multikey_sort():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (3000, 5), dtype=np.uint64)
    order = repeats.multikey_sort(words)
    assert sorted(order.tolist()) == list(range(3000))
    assert [tuple(r) for r in words[order].tolist()] == sorted(tuple(r) for r in words.tolist())


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
