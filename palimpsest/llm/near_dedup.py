"""MinHash near-dedup by a chosen-path set similarity join.

Each of TREES independent trees branches the documents by their minwise tokens: a document's node is
named by the minwise shingles chosen on the way to it, so similar documents take the same path often and
others part early.  Nodes of at most SMALL documents are compared exhaustively, larger ones branch
further: by three tokens, then two, then on two branches by three more each.  A pair at the
threshold shares a node of the last level in some tree but for a chance of about 0.003, and a node of the
second level but for 0.0004, which counts where nodes are small by then.

What is still large at the last level is a family.  Its documents are compared with two drawn from the
node, others in every tree, which joins close copies at little cost.  Families that share documents are then
taken as one, and where such a family holds several components, every document outside its largest
one is compared with all others, block against block on the full sets, within tasks: no pair is left out,
none becomes a row unless it is a link, and a family whose members stay apart costs the square of its size.

Equal sets are one document throughout.  Candidates of small nodes first pass a 128-bit sketch (it errs at
five standard deviations from the threshold), then the full sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import connected_components, fresh_names, join_groups, materialize, release, shingle_hashes, word_hashes

#: A tree's path has PATH tokens of its own; the two last branches take the first BRANCH tokens of the trees these many places on.
TREES, PATH, BRANCH, OTHERS = 20, 5, 3, (7, 11)
SMALL = 24
#: Differing sketch bits of 128: a pair at similarity 0.8 differs in 12.8, standard deviation 3.4.
HASHES, SKETCH_BITS = 128, 30
#: Sets of a block in a family's comparison; a task holds two blocks.
BLOCK_BYTES = 4_000_000
#: Edges that one task unites at most: it holds their nodes, about 60 MB.
ONE_TASK_EDGES = 250_000

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FOLD = 1024


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(len(_MUL), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(grams), _FOLD):
        part = grams[i : i + _FOLD, None] ^ _XOR
        part *= _MUL
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs, one, two = [], [], [], [], []
            for text in batch.column(1):
                grams = np.unique(shingle_hashes(word_hashes(text.as_py()), width))
                sizes.append(len(grams))
                if not len(grams):
                    digests.append(None), sigs.append(None), one.append(None), two.append(None)
                    continue
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                least = min_hashes(grams)
                sigs.append((least[: TREES * PATH] >> np.uint64(32)).astype("<u2").tobytes())
                bits = np.packbits((least >> np.uint64(50) & np.uint64(1)).astype(np.uint8)).view("<i8")
                one.append(int(bits[0]))
                two.append(int(bits[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["doc", "n", "digest", "sig", "b1", "b2"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [np.unique(shingle_hashes(word_hashes(t.as_py()), width)).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["doc", "grams"])

    return run


class Forest:
    """What a task's links have joined so far.  Beyond a bound it forgets all, which only lets more links through."""

    def __init__(self, bound: int = 1_000_000):
        self.bound, self.parent = bound, {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        if len(self.parent) >= self.bound:
            self.parent.clear()
        self.parent[self.root(y)] = self.root(x)


def _confirm(percent: int):
    """Pairs compared on their full sets, but for those that the task's links have joined before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Forest()
        for batch in batches:
            a, b = [], []
            for x, y, gx, gy in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if joined.root(x) == joined.root(y):
                    continue
                left, right = np.frombuffer(gx.as_py(), "<u8"), np.frombuffer(gy.as_py(), "<u8")
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    joined.join(x, y)
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _differ(x: Column, y: Column) -> Column:
    return F.bit_count(x["b1"].bitwiseXOR(y["b1"])) + F.bit_count(x["b2"].bitwiseXOR(y["b2"]))


def _tokens(tree: Column, count: int) -> Column:
    return F.substring(F.col("sig"), tree * (2 * PATH) + 1, F.lit(2 * count))


def _levels() -> list[Column]:
    """The nodes of each level, from tree and path: one, one, and two."""
    path = lambda at, n: F.substring("path", 2 * at + 1, 2 * n)
    own = path(0, PATH)
    branches = [F.xxhash64(F.lit(2 + i), "tree", own, path(PATH + BRANCH * i, BRANCH)) for i in range(len(OTHERS))]
    return [F.xxhash64(F.lit(0), "tree", path(0, BRANCH)), F.xxhash64(F.lit(1), "tree", own), F.explode(F.array(*branches))]


def candidates(reps: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """``reps(doc, sig, b1, b2)``, distinct sets, at most ``number``, to distinct pairs (a, b, differ) with a < b, and what they leave open.

    Open are the rows (doc, node) of nodes still large at the last level.
    """
    rows = reps.select("doc", "b1", "b2", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    path = F.concat(_tokens(F.col("tree"), PATH), *[_tokens((F.col("tree") + k) % TREES, BRANCH) for k in OTHERS])
    active = rows.select("doc", "b1", "b2", "tree", path.alias("path"))
    pairs = None
    for level, node in enumerate(_levels()):
        rows = active.withColumn("node", node)
        # written, as join_groups reads them in several places: the branches are made once for the counts
        counts = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node-counts")
        rows = materialize(join_groups(rows, counts, "node", number * TREES * (len(OTHERS) if level == 2 else 1)), "nodes")
        small = rows.where(F.col("n") <= SMALL).groupBy("node").agg(F.collect_list(F.struct("doc", "b1", "b2")).alias("l"))
        near = lambda x, i: F.transform(
            F.filter(F.slice("l", i + 2, F.lit(SMALL)), lambda y: _differ(x, y) <= SKETCH_BITS),
            lambda y: F.struct(F.least(x["doc"], y["doc"]).alias("a"), F.greatest(x["doc"], y["doc"]).alias("b"), _differ(x, y).alias("differ")),
        )
        own = small.select(F.explode(F.flatten(F.transform("l", near))).alias("p")).select("p.*")
        pairs = own if pairs is None else pairs.union(own)
        active = rows.where(F.col("n") > SMALL).drop("node", "n")
    large = rows.where(F.col("n") > SMALL).select("doc", "b1", "b2", "node")
    member = F.struct("doc", "b1", "b2")
    drawn = large.groupBy("node").agg(F.min_by(member, F.xxhash64("node", "doc")).alias("x"), F.max_by(member, F.xxhash64("node", "doc")).alias("y"), F.count(F.lit(1)).alias("n"))
    met = join_groups(large, drawn, "node").select(member.alias("m"), F.explode(F.array("x", "y")).alias("o")).where("m.doc <> o.doc")
    met = met.select(F.least("m.doc", "o.doc").alias("a"), F.greatest("m.doc", "o.doc").alias("b"), _differ(F.col("m"), F.col("o")).alias("differ")).where(F.col("differ") <= SKETCH_BITS)
    return pairs.union(met).groupBy("a", "b").agg(F.min("differ").alias("differ")), large.select("doc", "node")


def families(large: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """``large(doc, node)``, ``number`` rows, to (doc, component, family, minor) of the families with several components of ``found``.

    Nodes that share documents are one family; ``minor`` are the documents outside the family's largest component.
    """
    rows = large.join(found.toDF("doc", "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    hubs = rows.groupBy("node").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("least < most")
    rows = materialize(join_groups(rows, hubs.select("node", "hub", "n"), "node", number).select("doc", "component", "hub"), "open-nodes")
    joined = connected_components(rows.select(F.col("hub").alias("a"), F.col("doc").alias("b")), ONE_TASK_EDGES)
    members = materialize(rows.select("doc", "component").distinct().join(joined.toDF("doc", "family"), "doc"), "families")
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.groupBy("family").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.sum("m").alias("n"))
    return join_groups(members, sizes, "family", members.count()).select("doc", "component", "family", (F.col("component") != F.col("major")).alias("minor"))


def _compare(percent: int):
    """One block of minor documents against one of their family: links that join components not joined here before."""

    def run(table: pa.Table) -> pa.Table:
        docs, groups, left = (table.column(c).to_numpy() for c in ("doc", "component", "left"))
        grams = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
        others = np.flatnonzero(~left)
        links: list[tuple[int, int]] = []
        if len(others):
            size = np.array([len(grams[i]) for i in others])
            known, place = np.unique(np.concatenate([grams[i] for i in others]), return_inverse=True)
            starts, theirs = np.cumsum(size) - size, groups[others]
            joined = Forest()
            for i in np.flatnonzero(left):
                at = np.searchsorted(known, grams[i])
                at = at[at < len(known)]
                own = np.zeros(len(known), np.int32)
                own[at[known[at] == grams[i][: len(at)]]] = 1
                both = np.add.reduceat(own[place], starts)
                near = (100 * both >= percent * (len(grams[i]) + size - both)) & (theirs != groups[i])
                for j in np.flatnonzero(near):
                    x, y = int(groups[i]), int(theirs[j])
                    if joined.root(x) != joined.root(y):
                        joined.join(x, y)
                        links.append((int(docs[i]), int(docs[others[j]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def family_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each family: ``members`` as families() gives them."""
    sets = _candidate_sets(members.select("doc"), texts, width)
    rows = materialize(members.join(sets, "doc").withColumn("bytes", F.octet_length("grams").cast("long")), "family-sets")
    blocks = lambda b: F.greatest(F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    parts = rows.groupBy("family").agg(blocks(F.sum(F.when(F.col("minor"), F.col("bytes")).otherwise(0))).alias("ps"), blocks(F.sum("bytes")).alias("qs"), F.count(F.lit(1)).alias("n"))
    rows = join_groups(rows, parts, "family", rows.count())
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = ["doc", "component", "grams"]
    left = rows.where("minor").select("family", own("ps").alias("p"), each("qs").alias("q"), F.lit(True).alias("left"), *told)
    right = rows.select("family", own("qs").alias("q"), each("ps").alias("p"), F.lit(False).alias("left"), *told)
    return left.unionByName(right).groupBy("family", "p", "q").applyInArrow(_compare(percent), "a long, b long")


def _candidate_sets(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Full sets of ``docs(doc)``; the texts move once, whatever the number of documents."""
    found = texts.join(docs.distinct().hint("merge"), "doc", "left_semi")
    return materialize(found.mapInArrow(_sets(width), "doc long, grams binary"), "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough: as many as join all that such pairs join."""
    left, right = sets.toDF("a", "ga"), sets.toDF("b", "gb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(_confirm(percent), "a long, b long")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found(node, component)`` with the components joined that ``links(a, b)`` lie between: only those take part."""
    if links.isEmpty():
        return found
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    base = found.union(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    a, b = base.toDF("a", "ca"), base.toDF("b", "cb")
    merged = connected_components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), ONE_TASK_EDGES)
    return base.join(merged.toDF("component", "merged"), "component", "left").select("node", F.coalesce("merged", "component").alias("component"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets hold the distinct shingles of ``width`` words; a text of fewer words is one shingle, one
    without words (or null) has an empty set and is linked with nothing; texts of any length count whole.  Documents are linked if
    100 * intersection >= percent * union; component_id is the least id that links lead to; kept
    marks the document with that id.  Rows that share an id are one document for linking; a null
    id is linked with nothing and kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    sig = materialize(texts.mapInArrow(_signatures(width), "doc long, n long, digest binary, sig binary, b1 long, b2 long"), "signatures")
    linked = sig.where("digest is not null and doc is not null")
    first = F.min_by(F.struct("sig", "b1", "b2"), "doc").alias("first")
    reps = materialize(linked.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"), first), "sets-once")
    number = sig.count()
    pairs, large = candidates(reps.select(F.col("rep").alias("doc"), "first.*"), number)
    reps = reps.drop("first")
    pairs = materialize(pairs, "pairs")
    release(spark)
    texts = texts.where("doc is not null")
    sets = _candidate_sets(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")), texts, width)
    # an id with several texts is one document
    again = linked.groupBy("doc").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    again = linked.select("doc", "digest").join(again, "doc", "left_semi").distinct()
    own = join_groups(again, reps, "digest", number).groupBy("doc").agg(F.sort_array(F.collect_set("rep")).alias("own")).where(F.size("own") > 1)
    own = own.select(F.get("own", F.lit(0)).alias("a"), F.explode(F.slice("own", 2, F.size("own"))).alias("b"))
    found = connected_components(_links(pairs.select("a", "b"), sets, percent).union(own), ONE_TASK_EDGES)
    if open_rows := large.count():
        release(spark)
        found = _joined(found, materialize(family_links(families(large, found, open_rows), texts, width, percent), "family-links"))
    # equal sets are in the component of the first of them
    placed = reps.join(found.toDF("rep", "component"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    placed = join_groups(linked.select("digest", "doc"), placed, "digest", number).groupBy("doc").agg(F.min("component").alias("component"))
    out = sig.select("doc", "n").join(placed, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; all columns stay, whatever their names.

    Of a component the smallest id stays, with all rows that have it; rows with a null id stay.
    """
    (gone,) = fresh_names(docs, "gone")
    found = components(docs, doc_id, text, width, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(doc_id).cast("long") == F.col(gone), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, two-word shingles, similarity 0.8."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents
), g as (
  select distinct doc_id, array_to_string(a[i:i + least(2, len(a)) - 1], ' ') as g
  from w, unnest(range(1, len(a) - least(2, len(a)) + 2)) t(i) where len(a) > 0
), n as (select doc_id, count(*) as n from g group by 1),
o as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared
  from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2
), e as (
  select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 80 * (na.n + nb.n - shared)
), l as (select a, b from e union all select b, a from e),
r(doc_id, c) as (
  select doc_id, doc_id from documents
  union
  select l.b, r.c from r join l on l.a = r.doc_id where r.c < l.b
)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.c) as component_id, d.doc_id = min(r.c) as kept
from documents d left join n on n.doc_id = d.doc_id join r on r.doc_id = d.doc_id group by d.doc_id
"""
