"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

Lines are lower-cased and cut into words, runs of letters, their marks and digits.  A line's SimHash has
BLOCKS blocks of BLOCK_BITS bits; each distinct word votes in one block only, which its hash chooses.  So a
word that changes, comes or goes touches two blocks at most, the other two stay, and lines meet under
the six pairs of blocks: two lines that differ in one word are met, however much that word changes, and
lines that differ in more as far as two blocks stay alike.  A pair of blocks that a line has fewer than
KEY_WORDS words in tells too little and is no key.  In lines of up to SHORT words each word is a block of
its own, and lines meet under what is left without one word.  Lines of BLOCK_LEAST to SHORT words meet in
both ways.

Keys of up to SMALL lines compare all pairs.  In larger ones each line is compared with the key's first,
then, block against block, every pair that lies between two groups not joined so far: a family
joined to its first costs no more than its size, and no pair that shares a key is left out.

Pairs are verified by their edit distance, counted in signs for lines of up to LONG words and in words
beyond.  The earliest line of each connected group stays.

All of it is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import connected_components, fresh_names, join_groups, materialize, pairs_within, perhaps_among, release

#: Lines of fewer words are compared for equality only.
MIN_WORDS = 5
#: Lines of up to SHORT words meet without one word, those of BLOCK_LEAST words or more under pairs of blocks.
SHORT, BLOCK_LEAST = 20, 16
BLOCKS, BLOCK_BITS, AGREE, KEY_WORDS = 4, 24, 2, 4
#: Keys of more lines compare with their first line, then between groups.
SMALL = 16
#: Links need an edit distance of at most this share of the longer line.
MAX_EDIT = 0.2
#: Up to this number of words, the edit distance counts signs.
LONG = 32
#: What stands between words beside blanks, line ends apart.  The inner class is looked at first and holds the most frequent signs.
BETWEEN = r"[^[abcdefghijklmnopqrstuvwxyz0123456789\n ]\p{L}\p{M}\p{N}]+"

#: Columns of hashes gain nothing from a dictionary, and building it costs a look-up for each value.
HASHED = {"parquet.enable.dictionary": "false"}

#: A word's hash votes with the bits 5 * i and 5 * i + 1 for i up to 11.  In the fast way a block's votes are summed in
#: twelve lanes of 5 bits, else in lanes of 15 bits, four to a long.
_LANES5 = sum(1 << 5 * i for i in range(12))
_LANES15 = sum(1 << 15 * i for i in range(4))
_FAST, _MOST_VOTES = 31, (1 << 14) - 1
_VOTES = [(r, q) for r in range(2) for q in range(3)]
#: A word's block is the range in which its hash lies.
_CUTS = [-(1 << 63) + (b << 64) // BLOCKS for b in range(1, BLOCKS)]
_PAIRS = list(combinations(range(BLOCKS), AGREE))


def normalized(text: Column) -> Column:
    """Lower-cased; each run of anything but letters, their marks, digits, blanks and line ends is one blank."""
    return F.regexp_replace(F.lower(text), BETWEEN, " ")


def _words(line: Column) -> Column:
    """The words of a normalised line that has some."""
    return F.array_remove(F.split(F.trim(line), " "), "")


def _hashes(words: str | Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _word_hashes(line: Column) -> Column:
    """The hashes of _words: what lies between two blanks goes as a hash, which costs no comparison of strings."""
    return F.array_remove(_hashes(F.split(line, " ")), F.xxhash64(F.lit("")))


def _blocks(lines: DataFrame, kept: list[str]) -> DataFrame:
    """Replace the hashes ``xs`` by x0.., the distinct ones of each block: sorted with the cuts among them, a block is a slice.

    Sorting, looking for a cut and slicing work on plain longs; a lambda for each block and hash would box them.
    """
    cuts = F.array(*[F.lit(c).cast("long") for c in _CUTS])
    lines = lines.select(*kept, F.sort_array(F.array_union("xs", cuts)).alias("xs"))
    at = [F.lit(0), *[F.array_position("xs", F.lit(c).cast("long")).cast("int") for c in _CUTS], F.size("xs") + 1]
    lines = lines.select(*kept, "xs", *[p.alias(f"p{b}") for b, p in enumerate(at)])
    part = lambda b: F.slice("xs", F.col(f"p{b}") + 1, F.col(f"p{b + 1}") - F.col(f"p{b}") - 1)
    return lines.select(*kept, *[part(b).alias(f"x{b}") for b in range(BLOCKS)])


def _sum(xs: str, value) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + value(x))


def _any_of(parts: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, parts)


def _block_values(lines: DataFrame, kept: list[str]) -> DataFrame:
    """Add v0.., the blocks' bits that more than half of their hashes x0.. have set, and k0.., the numbers of hashes."""
    blocks = range(BLOCKS)
    shifted = lambda x, n: F.shiftrightunsigned(x, n) if n else x
    lines = lines.select(*kept, *[F.col(f"x{b}") for b in blocks], *[F.size(f"x{b}").cast("long").alias(f"k{b}") for b in blocks])

    def fast(b: int, r: int) -> Column:
        """Bits 5 * i + r: votes and what more than half lacks of 16, in all lanes at once; the last lane ends below bit 61."""
        votes = shifted(_sum(f"x{b}", lambda x: x.bitwiseAND(F.lit(_LANES5 << r))), r)
        more = F.shiftrightunsigned(votes + (F.lit(15).cast("long") - F.shiftright(f"k{b}", 1)) * F.lit(_LANES5), 4)
        return F.shiftleft(more.bitwiseAND(F.lit(_LANES5)), r)

    def wide(b: int, r: int, q: int) -> Column:
        """Bits 15 * i + 5 * q + r: twice the votes against the number of words, bit 14 says which is more."""
        votes = _sum(f"x{b}", lambda x: shifted(x, r + 5 * q).bitwiseAND(F.lit(_LANES15)))
        more = F.shiftrightunsigned(F.lit(_MOST_VOTES * _LANES15) + 2 * votes - F.col(f"k{b}") * _LANES15, 14)
        return F.shiftleft(more.bitwiseAND(F.lit(_LANES15)), r + 5 * q)

    def many(b: int, bit: int) -> Column:
        """One bit: blocks of more words than a lane counts take a sum for each."""
        votes = _sum(f"x{b}", lambda x: shifted(x, bit).bitwiseAND(F.lit(1).cast("long")))
        return F.when(2 * votes > F.col(f"k{b}"), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))

    def spread(b: int) -> Column:
        """The block's 24 bits, at 5 * i and 5 * i + 1."""
        few, some = F.col(f"k{b}") <= _FAST, F.col(f"k{b}") <= _MOST_VOTES
        ways = F.when(few, fast(b, 0).bitwiseOR(fast(b, 1))).when(some, _any_of([wide(b, r, q) for r, q in _VOTES]))
        return ways.when(~some, _any_of([many(b, 15 * i + r + 5 * q) for r, q in _VOTES for i in range(4)]))

    lines = lines.select(*kept, *[F.col(f"k{b}") for b in blocks], *[spread(b).alias(f"v{b}") for b in blocks])
    # neighbours move together: 2 bits of every 5, 4 of every 10, 8 of every 20
    for bits, gap, n in ((2, 5, 12), (4, 10, 6)):
        mask = sum(((1 << bits) - 1) << 2 * gap * i for i in range(n // 2))
        close = lambda v: v.bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftrightunsigned(v, gap - bits).bitwiseAND(F.lit(mask << bits)))  # noqa: E731, B023
        lines = lines.select(*kept, *[F.col(f"k{b}") for b in blocks], *[close(F.col(f"v{b}")).alias(f"v{b}") for b in blocks])
    joined = lambda v: _any_of([F.shiftrightunsigned(v, 12 * i).bitwiseAND(F.lit(255 << 8 * i).cast("long")) for i in range(3)])
    return lines.select(*kept, *[F.col(f"k{b}") for b in blocks], *[joined(F.col(f"v{b}")).alias(f"v{b}") for b in blocks])


def line_hashes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, line_no (from 0), h (64-bit hash of the words in order), n, short (word hashes of short lines), s1 and s2 of every line; n is 0 without words.

    s1 and s2 hold the SimHash of longer lines, two blocks each, and from bit 48 on how many
    distinct words voted in them, 15 at most.  All is made within the row: nothing moves for it.
    """
    # lower-casing takes ASCII faster, and most lines of other texts are ASCII
    lines = docs.select(F.col(doc_id).cast("long").alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.select("doc", "line_no", _word_hashes(normalized(F.col("line"))).alias("all"))
    lines = lines.withColumns({"n": F.size("all"), "h": F.xxhash64("all")})
    xs = F.when(F.col("n") >= BLOCK_LEAST, F.col("all"))
    # 56 bits of a hash, so that the sum of SHORT stays a long
    short = F.when(F.col("n").between(MIN_WORDS, SHORT), F.transform("all", lambda x: F.shiftrightunsigned(x, 8)))
    kept = ["doc", "line_no", "h", "n", "short"]
    lines = lines.select("doc", "line_no", "h", "n", short.alias("short"), xs.alias("xs"))
    lines = _block_values(_blocks(lines, kept), kept)
    half = lambda b: _any_of([F.col(f"v{b}"), F.shiftleft(f"v{b + 1}", BLOCK_BITS), F.shiftleft(F.least(f"k{b}", F.lit(15)), 48), F.shiftleft(F.least(f"k{b + 1}", F.lit(15)), 52)])
    return lines.select(*kept, *[F.when(F.col("n") >= BLOCK_LEAST, half(b)).alias(s) for s, b in (("s1", 0), ("s2", 2))])


def line_keys(lines: DataFrame) -> DataFrame:
    """``lines(h, n, short, s1, s2)`` to (key, h), a row for every block key."""
    part = lambda b, at, bits: F.shiftrightunsigned(F.col("s1" if b < 2 else "s2"), at).bitwiseAND(F.lit((1 << bits) - 1))
    value, votes = (lambda b: part(b, BLOCK_BITS * (b % 2), BLOCK_BITS)), (lambda b: part(b, 48 + 4 * (b % 2), 4))
    pairs = F.array(*[F.when(votes(i) + votes(j) >= KEY_WORDS, F.xxhash64(F.lit(t), value(i), value(j))) for t, (i, j) in enumerate(_PAIRS)])
    # two kinds of lines, one after the other: the pairs need no lambda, so their rows are made in generated code
    blocks = lines.where(F.col("n") >= BLOCK_LEAST).select("h", F.explode(pairs).alias("key")).where("key is not null")
    without = F.array_distinct(F.array_append(F.transform("short", lambda x: F.col("total") - x), F.col("total")))
    short = lines.where(F.col("n").between(MIN_WORDS, SHORT)).withColumn("total", _sum("short", lambda x: x))
    return blocks.union(short.select("h", F.explode(without).alias("key")))


def shared_keys(lines: DataFrame) -> DataFrame:
    """(key, h, members, first) of the keys that two or more of ``lines``, distinct by h, have."""
    own = Window.partitionBy("key")
    met = line_keys(lines).select("key", "h", F.count(F.lit(1)).over(own).alias("members"), F.min("h").over(own).alias("first"))
    return met.where("members > 1")


def first_pairs(met: DataFrame) -> DataFrame:
    """``met`` of shared_keys to distinct pairs (a, b): all of the small keys, those with the key's first of the others."""
    near = lambda x, i: F.transform(F.slice("l", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    small = met.where(F.col("members") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("l"))
    small = small.select(F.inline(F.flatten(F.transform("l", near))))
    star = met.where((F.col("members") > SMALL) & (F.col("h") > F.col("first"))).select(F.col("first").alias("a"), F.col("h").alias("b"))
    return small.union(star).distinct()


def open_pairs(met: DataFrame, groups: DataFrame, lengths: DataFrame) -> DataFrame:
    """The pairs (a, b) under large keys that ``groups(node, component)`` don't join and whose lengths allow a link.

    ``lengths(h, n, chars)``.  A key is dealt in blocks of lines that meet each other, so no task holds a key.
    """
    rows = met.where(F.col("members") > SMALL).select("key", "h").join(groups.toDF("h", "component"), "h", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "h")), "large-keys")
    apart = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    rows = join_groups(rows, apart.select("key", "n"), "key").withColumnRenamed("n", "members").join(lengths, "h")

    def near(x: str, y: str) -> Column:
        size = F.when(F.greatest(f"{x}.n", f"{y}.n") > LONG, F.struct(F.col(f"{x}.n").alias("p"), F.col(f"{y}.n").alias("q"))).otherwise(F.struct(F.col(f"{x}.chars").alias("p"), F.col(f"{y}.chars").alias("q")))
        return (F.col(f"{x}.component") != F.col(f"{y}.component")) & (F.abs(size["p"] - size["q"]) <= F.greatest(size["p"], size["q"]) * MAX_EDIT)

    found = pairs_within(rows, "key", ["h", "component", "n", "chars"], near)
    return found.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")).distinct()


def _common(x: str, y: str) -> Column:
    """How many signs two texts begin with alike, up to 511."""
    steps = F.array(*[F.lit(1 << k) for k in range(8, -1, -1)])
    alike = lambda n, step: F.substr(x, n + 1, step) == F.substr(y, n + 1, step)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(alike(n, step), n + step).otherwise(n))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``texts(h, norm, codes, n, longest)`` whose edit distance is at most MAX_EDIT of the longer line.

    Beyond LONG words the distance is that of ``codes``, a sign for every word, and looked for within
    a few words first: near lines then cost no more than their length.  Shorter lines count the signs
    of their texts; words that differ settle most of them, as each costs at most the longest word and
    its blank.  A word to spare covers two words with one code.  What is left is looked for without the
    beginning and the end that both lines have, which don't change the distance.
    """
    side = lambda s: texts.select(F.col("h").alias(s), F.struct("norm", "codes", "n", "longest").alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    long = F.greatest("ta.n", "tb.n") > LONG
    size = lambda t: F.when(long, F.col(f"{t}.n")).otherwise(F.length(f"{t}.norm"))
    both = both.withColumns({"long": long, "allowed": F.floor(F.greatest(size("ta"), size("tb")) * MAX_EDIT).cast("int")})
    both = both.where(F.abs(size("ta") - size("tb")) <= F.col("allowed"))
    both = both.withColumn("swaps", F.when(F.col("long"), F.col("allowed")).otherwise(F.floor(F.col("allowed") / (F.greatest("ta.longest", "tb.longest") + 1)).cast("int") - 1))
    both = both.withColumn("found", F.expr("swaps >= 0 and levenshtein(ta.codes, tb.codes, least(greatest(swaps, 0), 8)) >= 0"))
    both = both.withColumn("most", F.when(~F.col("found"), F.when(F.col("long"), F.col("swaps")).otherwise(F.col("allowed"))))
    both = both.select("a", "b", "most", "found", *[F.when(F.col("most").isNotNull(), F.when(F.col("long"), F.col(f"t{s}.codes")).otherwise(F.col(f"t{s}.norm"))).alias(s + "0") for s in "ab"])
    for k in range(2):  # the second time from the end
        both = both.withColumn("n", F.when(~F.col("found"), _common(f"a{k}", f"b{k}")))
        both = both.select("a", "b", "most", "found", *[F.reverse(F.substr(f"{s}{k}", F.col("n") + 1)).alias(f"{s}{k + 1}") for s in "ab"])
    within = F.expr("levenshtein(a2, b2, least(most, 128)) >= 0 or (most > 128 and levenshtein(a2, b2, most) >= 0)")  # -1 beyond the threshold
    # a generator, as a filter would be worked out below the columns that it uses, each as often as it is used
    return both.select(F.explode(F.when(F.col("found") | within, F.array(F.struct("a", "b")))).alias("p")).select("p.a", "p.b")


def line_texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(h, norm, codes, n, longest) of the lines ``wanted(doc, line_no)``, their first occurrences.

    ``codes`` has a sign for every word, from 15 bits of its hash; ``longest`` is the longest word's length.
    """
    none = F.lit(-1 << 63)
    by_doc = wanted.groupBy(F.coalesce("doc", none).alias("doc")).agg(F.collect_set("line_no").alias("wanted"))
    by_doc = materialize(by_doc, "wanted-lines")  # counted, and used twice
    some = docs.select(F.coalesce(F.col(doc_id).cast("long"), none).alias("doc"), F.col(text).alias("text"))
    # most texts that no one wants stay where they are
    some = perhaps_among(some, by_doc, "doc").join(by_doc.hint("shuffle_hash"), "doc")
    # only the wanted lines are normalised
    some = some.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("line_no")).select(F.get("lines", F.col("line_no")).alias("line"))
    some = some.where("line is not null").select(normalized(F.col("line")).alias("line"))
    some = some.select(_words(F.col("line")).alias("words")).select("words", _hashes("words").alias("all"))
    # where documents share an id, lines that no one wants come along under their own hash
    some = some.select("words", "all", F.xxhash64("all").alias("h"))
    # four hex digits each, below the surrogates
    sign = lambda x: F.hex(x.bitwiseAND(F.lit(0x7FFF)) + F.lit(0x1000))
    codes = F.decode(F.unhex(F.array_join(F.transform("all", sign), "")), "UTF-16BE")
    return some.select("h", F.array_join("words", " ").alias("norm"), codes.alias("codes"), F.size("words").alias("n"), F.array_max(F.transform("words", F.length)).alias("longest")).dropDuplicates(["h"])


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that go: (doc, drop), ``drop`` the array of their numbers.

    The earliest line, by document id (null first) and line number, of each connected group stays;
    lines without a letter or digit belong to no group.
    """
    spark = docs.sparkSession
    first_of = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "line_no")
    # a filter before the hashes are written would have them worked out twice
    lines = materialize(line_hashes(docs, doc_id, text), "lines", **HASHED).where("n > 0")
    release(spark)
    one = [F.first(c).alias(c) for c in ("n", "short", "s1", "s2")]
    distinct = materialize(lines.groupBy("h").agg(F.min(first_of).alias("at"), F.count(F.lit(1)).alias("times"), *one), "distinct-lines", **HASHED)
    met = materialize(shared_keys(distinct), "line-keys", **HASHED)
    release(spark)
    pairs = materialize(first_pairs(met), "line-pairs")
    large = met.where(F.col("members") > SMALL)
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(large.select("h")).distinct()
    wanted = wanted.join(distinct, "h").select("at.doc", "at.line_no")
    texts = materialize(line_texts(docs, doc_id, text, wanted), "line-texts")
    release(spark)
    links = materialize(similar(pairs, texts), "line-links")
    groups = connected_components(links)
    missed = materialize(open_pairs(met, groups, texts.select("h", "n", F.length("norm").alias("chars"))), "open-pairs")
    more = materialize(similar(missed.join(pairs, ["a", "b"], "left_anti"), texts), "line-links")
    release(spark)
    if not more.isEmpty():
        groups = connected_components(links.union(more))
    firsts = distinct.join(groups.toDF("h", "component"), "h", "left").where(F.col("component").isNotNull() | (F.col("times") > 1))
    firsts = materialize(firsts.select("h", F.coalesce("component", "h").alias("component"), "at", "times"), "first-lines")
    keep = firsts.groupBy("component").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    repeated = join_groups(firsts.select("h", "component", "times"), keep, "component")
    repeated = materialize(repeated.select("h", F.col("times").alias("n"), F.col("keep.doc").alias("kd"), F.col("keep.line_no").alias("kl")), "repeated-lines")
    gone = join_groups(lines.select("doc", "line_no", "h"), repeated, "h").where(~(F.col("doc").eqNullSafe(F.col("kd")) & (F.col("line_no") == F.col("kl"))))
    return gone.groupBy("doc").agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines and n_removed added.

    Null texts stay null (no lines); empty texts have one line, which stays; texts and lines of any
    length count whole.  Of equal lines, and of ties in any respect, the earliest by document and
    place stays.  Rows that share an id (or have none) count as one document, so their equal lines at
    equal places stay or go together.  An empty table gives an empty result.  Columns of the input
    named n_lines and n_removed are replaced; all others stay, whatever their names.
    """
    doc, drop, lines = fresh_names(docs, "doc", "drop", "lines")
    gone = duplicate_lines(docs, doc_id, text).toDF(doc, drop)
    # the texts are neither sorted nor held for it: one side's task has the numbers of its documents' lines only
    df = docs.drop("n_lines", "n_removed").join(gone.hint("shuffle_hash"), F.col(doc_id).cast("long").eqNullSafe(F.col(doc)), "left")
    # only texts that lose a line are split
    df = df.withColumn(lines, F.when(F.col(drop).isNotNull(), F.split(text, "\n")))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.sort_array(F.array_except(every, F.col(drop))), lambda i: F.get(F.col(lines), i)), "\n")
    return df.withColumns(
        {
            "n_lines": F.coalesce(breaks + 1, F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(drop), F.lit(0)).cast("long"),
            text: F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept),
        }
    ).drop(doc, drop, lines)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
