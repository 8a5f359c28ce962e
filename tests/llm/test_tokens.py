"""Token store and packing against brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from palimpsest.llm import packing, token_store
from palimpsest.llm.common import shared_path
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids string"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(9000))
ROWS = [
    (5, "Hello  world \n again", "a", "b"),
    (2, "", None, None),
    (None, "no id here", "a", "b"),
    (7, None, "a", "b"),
    (3, LONG, "a", "b"),
    (4, LONG + " tail", "a", "b"),
    (9, "same same", "x", "y"),
    (9, "same same", "x", "y"),
    (1, "é́ Straße <|endoftext|> 12 345 'S  ", "a", "b"),
    (10, "<|endoftext|> hi <|endoftext|>", "a", "b"),
    (11, "plain <s> [UNK] <unk> </s>hi <pad>[PAD]", "a", "b"),
]


def expected_ids(path, text):
    tok = Tokenizer.from_file(path)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark):
    path = shared_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame(ROWS, SCHEMA), path, BYTE)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.verify(spark, path).collect()))
    want, start = [], 0
    docs = sorted(((r[0], expected_ids(BYTE, r[1])) for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    for doc_id, ids in docs:
        want.append((start, doc_id, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    for r in token_store.read_documents(spark, path).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == dict((s, i) for (s, *_), (_, i) in zip(want, docs))[r.start]
    assert len(token_store.store_root(spark, path)) == 32
    chunks = token_store._data(spark, path, "chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()
    # the long text and its longer copy share most chunks
    assert chunks.agg({"n": "sum"}).first()[0] < 1.2 * len(expected_ids(BYTE, LONG)) + 200


def test_streams_of_a_slice_are_cut_together(monkeypatch):
    # the ends are those of each stream alone, and hashing costs a few calls a slice, not a few for each document
    rng = np.random.default_rng(3)
    for dtype in (np.dtype("<u2"), np.dtype("<u4")):
        streams = [rng.integers(0, most, n).astype(dtype) for most in (2, 50000) for n in (1, 15, 63, 64, 65, 66, 130, 600, 4097, 20000)]
        assert token_store._cuts([s.tobytes() for s in streams], dtype) == [token_store.cut_points(s).tolist() for s in streams]
    calls = []
    monkeypatch.setattr(token_store, "mix64", lambda x, f=token_store.mix64: calls.append(len(x)) or f(x))
    texts = [f"a text of its own, number {i}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([" ".join([t] * 30) for t in texts])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(token_store._chunk_rows(BYTE, 0)(iter([batch])))
    assert rows.column("kind").to_pylist().count("recipe") == 300
    assert len(calls) <= 2


def test_store_empty(spark):
    path = shared_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([], SCHEMA), path, BYTE)
    assert token_store.verify(spark, path).count() == 0


def test_damage_is_found(spark):
    path = shared_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame(ROWS, SCHEMA), path, BYTE)
    kept = token_store._data(spark, path, "chunk").where("n < 10").collect()
    chunks = token_store._data(spark, path, "chunk")
    spark.createDataFrame(kept, chunks.schema).drop("kind").write.mode("overwrite").parquet(f"{path}/data/kind=chunk")
    with pytest.raises(Exception, match="damaged"):
        token_store.verify(spark, path).collect()


def test_crc_shift():
    rng = np.random.default_rng(1)
    a, b = rng.bytes(1000), rng.bytes(77777)
    moved = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
    assert moved ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_packing(spark):
    out = [r.asDict() for r in packing.pack(spark.createDataFrame(ROWS, SCHEMA), WORD, capacity=64).collect()]
    check_packing(out, [(r[0], expected_ids(WORD, r[1])) for r in ROWS], 64)


def check_packing(out, docs, capacity):
    want = Counter()
    for doc_id, ids in docs:
        for k in range(0, len(ids), capacity):
            want[(doc_id, k // capacity, k, tuple(ids[k : k + capacity]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in out) == want
    by_seq = {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 37, 256]))
    counts = Counter(rng.integers(1, capacity + 1, rng.integers(0, 300)).tolist())
    got, sequences = Counter(), 0
    for number, items in packing.plan(dict(counts), capacity):
        assert sum(s * k for s, k in items) <= capacity
        assert sum(k for s, k in items if 3 * s > capacity) <= 2
        sequences += number
        for s, k in items:
            got[s] += number * k
    assert got == counts
    # no worse than first-fit decreasing
    bins = []
    for s in sorted(counts.elements(), reverse=True):
        for i, left in enumerate(bins):
            if left >= s:
                bins[i] -= s
                break
        else:
            bins.append(capacity - s)
    assert sequences <= 1.05 * len(bins) + 1
