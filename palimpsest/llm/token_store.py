"""Content-addressed store of token ids.

``write_store`` encodes documents, cuts each id stream where a rolling hash of the last ids says so,
and keeps every distinct chunk once under its digest.  A document is a recipe: its digests in order,
and the root of the Merkle tree over them.  Folder of a store:

* ``data/kind=chunk``: digest, n, payload (little-endian ids, 2 bytes each, 4 for large vocabularies)
* ``recipes``: doc_id, start, n_tokens, chunks (digests end to end), lens, root; ascending doc_id
* ``manifest``: for each range of recipes, its bounds, counts and Merkle root

``read_documents`` gives the ids back; ``verify`` proves from the files that every recipe can be
rebuilt, and returns each document's checksum, without moving payloads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import mix64, running_start, shared_path
from palimpsest.llm.tokenize import encoder, slices

#: Chunk lengths in ids: none shorter than MIN but a document's last, none longer than MAX; between, a cut at 1 in MASK + 1 places.
MIN_CHUNK, MASK, MAX_CHUNK = 64, 511, 4096
WINDOW = 16
DIGEST = 16
_SEEN_BOUND = 1_000_000

DATA_SCHEMA = "kind string, pkey binary, digest binary, n int, payload binary, doc_id long, n_tokens long, chunks binary, lens binary, root binary"


_MIXED: np.ndarray | None = None


def _spots(ids: np.ndarray) -> np.ndarray:
    """Places behind which the last WINDOW ids say that a chunk may end."""
    global _MIXED
    if ids.dtype.itemsize > 2:
        h = mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    else:
        if _MIXED is None:
            _MIXED = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h = _MIXED[ids]
    width = 1
    while width < WINDOW:  # doubling: a hash of 2w ids from two of w
        h[width:] += np.uint64(0xD6E8FEB86659FD93) * h[:-width]
        width *= 2
    return np.flatnonzero(h & np.uint64(MASK << 40) == 0) + 1


def _ends(spots: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids.  Spots before MIN_CHUNK are never taken, so the first may be wrong."""
    ends, last = [], 0
    for s in [*spots, n]:
        while s - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if s - last >= MIN_CHUNK or s == n and s > last:
            ends.append(s)
            last = s
    return ends


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one id stream; depend on the ids of the last WINDOW places only."""
    return np.array(_ends(_spots(ids).tolist(), len(ids)), int)


def _cuts(raws: list[bytes], dtype: np.dtype) -> list[list[int]]:
    """``cut_points`` of each stream, hashed end to end: only spots in a stream's first WINDOW places differ, and none of those is taken."""
    bounds = np.cumsum([0, *map(len, raws)]) // dtype.itemsize
    spots = _spots(np.frombuffer(b"".join(raws), dtype))
    at = np.searchsorted(spots, bounds, "right").tolist()
    bounds = bounds.tolist()
    return [_ends((spots[i:j] - begin).tolist(), end - begin) for i, j, begin, end in zip(at, at[1:], bounds, bounds[1:], strict=False)]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; a lone node moves up unchanged; no leaves: digest of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=DIGEST).digest()
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _chunk_rows(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), set()
        end = np.array([end_id], enc.dtype).tobytes()
        step = enc.dtype.itemsize
        schema = pa.schema([("kind", pa.string()), ("pkey", pa.binary()), ("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.binary()), ("lens", pa.binary()), ("root", pa.binary())])
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, 2_000_000):
                rows = []
                raws = [raw + end for raw in enc.encode(texts[a:b])]
                for doc_id, raw, ends in zip(doc_ids[a:b], raws, _cuts(raws, enc.dtype), strict=True):
                    digests, lens, last = [], [], 0
                    for e in ends:
                        piece = raw[last * step : e * step]
                        d = hashlib.blake2b(piece, digest_size=DIGEST).digest()
                        if d not in seen:
                            if len(seen) >= _SEEN_BOUND:
                                seen.clear()
                            seen.add(d)
                            rows.append(("chunk", d, d, e - last, piece, None, None, None, None, None))
                        digests.append(d)
                        lens.append(e - last)
                        last = e
                    root = merkle_root(digests)
                    key = hashlib.blake2b(root + str(doc_id).encode(), digest_size=DIGEST).digest()
                    rows.append(("recipe", key, None, None, None, doc_id, len(raw) // step, b"".join(digests), np.array(lens, "<u4").tobytes(), root))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _manifest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots, part, first, last, tokens = [], None, None, None, 0
    count = 0
    for batch in batches:
        for p, doc_id, n, root in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if part is not None and p != part:
                yield _manifest_row(part, first, last, count, tokens, roots)
                roots, tokens, count, first = [], 0, 0, None
            if not count:
                first = doc_id
            part, last, tokens, count = p, doc_id, tokens + n, count + 1
            roots.append(root)
            if len(roots) >= 65536:  # fold: memory stays bounded
                roots = [merkle_root(roots)]
    if part is not None:
        yield _manifest_row(part, first, last, count, tokens, roots)


def _manifest_row(part, first, last, count, tokens, roots) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first_doc": pa.array([first], pa.int64()), "last_doc": pa.array([last], pa.int64()), "n_docs": pa.array([count], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()), "root": pa.array([merkle_root(roots)], pa.binary())})


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the store of ``docs`` at ``path``.

    Null text is empty and holds the end id alone; a null doc_id sorts first; rows repeated with
    the same id and text have a recipe each.  An empty table gives an empty store.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_chunk_rows(tokenizer, end_id), DATA_SCHEMA)
    # a task sends a chunk once, so a chunk that most documents share is no hot key
    by_key = Window.partitionBy("pkey", "kind").orderBy("n")
    once = rows.withColumn("rn", F.row_number().over(by_key)).where("rn = 1 or kind = 'recipe'").drop("rn", "pkey")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    recipes = _data(spark, path, "recipe").select("doc_id", "n_tokens", "chunks", "lens", "root")
    placed = running_start(recipes, ["doc_id", "root"], "n_tokens", "start").withColumnRenamed("_range", "part")
    placed = placed.sortWithinPartitions("part", "start")
    placed.write.parquet(f"{path}/recipes")
    done = spark.read.parquet(f"{path}/recipes").select("part", "doc_id", "n_tokens", "root", "start")
    done = done.repartition("part").sortWithinPartitions("part", "start").drop("start")
    done.mapInArrow(_manifest_rows, "part int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary").write.parquet(f"{path}/manifest")


def _data(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(DATA_SCHEMA.replace(" pkey binary,", "")).parquet(f"{path}/data").where(F.col("kind") == kind)


def store_root(spark: SparkSession, path: str) -> str:
    """Hex root over the ranges of the manifest (one row per range of recipes)."""
    return merkle_root([bytes(r["root"]) for r in spark.read.parquet(f"{path}/manifest").orderBy("part").collect()]).hex()


def _recipe_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per place of a recipe: start, position, digest, n, bytes that follow it (as 4-byte ids); checks the root."""
    for batch in batches:
        starts, recipes, lens, roots = (c.to_pylist() for c in batch.columns)
        links: list[bytes] = []
        for start, chunks, own, root in zip(starts, recipes, lens, roots, strict=True):
            digests = [chunks[i : i + DIGEST] for i in range(0, len(chunks), DIGEST)]
            if merkle_root(digests) != root:
                raise ValueError(f"recipe at {start}: Merkle root differs")
            if len(own) != 4 * len(digests):
                raise ValueError(f"recipe at {start}: as many lengths as chunks are needed")
            links += digests
        counts = np.array([len(own) // 4 for own in lens], int)
        upto = np.cumsum(counts)
        n = np.frombuffer(b"".join(lens), "<u4").astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        after = (np.repeat(before[upto], counts) - before[1:]) * 4
        pos = np.arange(len(n)) - np.repeat(upto - counts, counts)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((np.repeat(np.array(starts, np.int64), counts), pa.int64()), (pos, pa.int32()), (links, pa.binary()), (n, pa.int64()), (after, pa.int64()))], names=["start", "pos", "digest", "n", "after"])


def _links(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes").select("start", "chunks", "lens", "root")
    return recipes.mapInArrow(_recipe_links, "start long, pos int, digest binary, n long, after long")


def _chunk_sums(id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = payload.as_py()
                if hashlib.blake2b(raw, digest_size=DIGEST).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()}: payload differs from its digest")
                sums.append((len(raw) // id_bytes, zlib.crc32(np.frombuffer(raw, f"<u{id_bytes}").astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], names=["digest", "found", "crc"])

    return run


def _crc_matrices(count: int = 48) -> np.ndarray:
    """Row k: the linear map that 2**k zero bytes apply to a CRC-32."""
    one_bit = [0xEDB88320] + [1 << i for i in range(31)]

    def apply(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = one_bit
    for _ in range(3):
        m = [apply(m, x) for x in m]
    rows = []
    for _ in range(count):
        rows.append(m)
        m = [apply(m, x) for x in m]
    return np.array(rows, np.uint32)


_MATRICES: np.ndarray | None = None


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as they count in a longer message with ``n_bytes`` more bytes behind: XOR them to combine."""
    global _MATRICES
    if _MATRICES is None:
        _MATRICES = _crc_matrices()
    out = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(n_bytes >> k & 1)
        v, moved = out[at], np.zeros(len(at), np.uint32)
        for i in range(32):
            moved ^= np.where(v >> np.uint32(i) & np.uint32(1), _MATRICES[k, i], np.uint32(0))
        out[at] = moved
    return out


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, n, after, found, crc = (batch.column(i) for i in range(5))
        moved = crc_shift(crc.to_numpy(zero_copy_only=False), after.to_numpy(zero_copy_only=False)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([start, n, found, pa.array(moved)], names=["start", "n", "found", "part_crc"])


def verify(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """Read every file of the store back: doc_id, start, n_tokens, ids_crc32 of each document.

    Each chunk's payload is read once, checked against its digest and reduced to its checksum;
    a document's checksum follows from those of its chunks in order.  A missing chunk, a wrong
    length or a wrong root fails the job.
    """
    chunks = _data(spark, path, "chunk").select("digest", "payload").mapInArrow(_chunk_sums(id_bytes), "digest binary, found long, crc long")
    links = _links(spark, path)
    parts = links.join(chunks, "digest", "left").select("start", "n", "after", F.coalesce("found", F.lit(-1)).alias("found"), F.coalesce("crc", F.lit(0)).alias("crc"))
    parts = parts.mapInArrow(_shifted, "start long, n long, found long, part_crc long")
    sums = parts.groupBy("start").agg(F.bit_xor("part_crc").alias("ids_crc32"), F.sum("found").alias("found"), F.count_if(F.col("n") != F.col("found")).alias("wrong"))
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens")
    sound = (F.col("wrong") == 0) & (F.col("found") == F.col("n_tokens"))
    return recipes.join(sums, "start").select("doc_id", "start", F.when(sound, F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("store is damaged at document "), F.col("doc_id"))).cast("long")).alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the documents: doc_id, start, n_tokens, ids (binary as in the chunks)."""
    chunks = _data(spark, path, "chunk").select("digest", "payload")
    built = _links(spark, path).join(chunks, "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["payload"]))
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens")
    return recipes.join(built, "start").select("doc_id", "start", "n_tokens", joined.alias("ids"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with byte_bpe_50k.json, end id 0, read back from the store's files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "token-store")
    write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return verify(spark, path)
