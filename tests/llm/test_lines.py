"""Line dedup against all pairs, by an own SimHash and an own edit distance."""

import random
import re
import unicodedata
from itertools import combinations

import xxhash
from palimpsest.llm import line_dedup as ld
from palimpsest.llm.common import materialize, perhaps_among

SCHEMA = "doc_id long, text string, n_lines string, doc string, drop string, lines string, _doc string"


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.2:
                line.insert(rng.randrange(len(line)), rng.choice(words))
            lines.append(" ".join(line) + rng.choice(["", ".", " !"]))
        rows.append((i + 1, "\n".join(lines), "x", "y", None, "z", "v"))
    none = (None,) * 5
    rows += [(None, base[3] + "\n---\n\n" + base[3], *none), (90, None, *none), (91, "", *none), (92, "---\n---", *none), (1, rows[0][1], *none)]
    many = rng.choices([f"w{i}" for i in range(60000)], k=100000)  # more words than a lane counts
    rows += [(93, " ".join(many), *none), (94, " ".join([*many[:-1], "other"]), *none)]
    rows += [(95, " ".join(f"v{i}" for i in range(200)), *none), (96, " ".join(f"v{i}" for i in range(1, 200)), *none)]
    return rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    """At most a fifth of the longer line differs: in words beyond 32, else in signs."""
    x, y = a.split(), b.split()
    if max(len(x), len(y)) <= 32:
        x, y = a, b
    most = max(len(x), len(y)) // 5
    if abs(len(x) - len(y)) > most:
        return False
    while x and y and x[0] == y[0] and len(x) > 2000:
        x, y = x[1000:] if x[:1000] == y[:1000] else x[1:], y[1000:] if x[:1000] == y[:1000] else y[1:]
    return distance(x, y) <= most


def normal(line):
    signs = (c if unicodedata.category(c)[0] in "LMN" else " " for c in line.lower())
    return " ".join("".join(signs).split())


def word_hash(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def keys_of(line):
    """What the docstring of the module says, by plain loops."""
    words = line.split()
    out = set()
    if 5 <= len(words) <= 20:
        out |= {("short", tuple(sorted(words[:i] + words[i + 1 :]))) for i in range(len(words))} | {("short", tuple(sorted(words)))}
    if len(words) >= 16:
        blocks = [[] for _ in range(4)]
        for h in {word_hash(w) for w in words}:
            signed = h - (1 << 64) if h >> 63 else h
            blocks[(signed + (1 << 63)) >> 62].append(h)
        value = [tuple(2 * sum(h >> 5 * i + r & 1 for h in b) > len(b) for r in range(2) for i in range(12)) for b in blocks]
        for i, j in combinations(range(4), 2):
            if min(15, len(blocks[i])) + min(15, len(blocks[j])) >= 4:
                out.add((i, j, value[i], value[j]))
    return out


def expected(rows):
    at = {}
    for doc, text, *_ in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if normal(line):
                at.setdefault(normal(line), set()).add((doc is not None, doc or 0, k))
    parent = {n: n for n in at}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    under = {}
    for n in at:
        for key in keys_of(n):
            under.setdefault(key, []).append(n)
    for a, b in {tuple(sorted(p)) for names in under.values() for p in combinations(names, 2)}:
        if near(a, b):
            parent[root(a)] = root(b)
    groups = {}
    for n in at:
        groups.setdefault(root(n), set()).update(at[n])
    return {p for g in groups.values() for p in g - {min(g)}}


def check(spark, rows):
    gone = expected(rows)
    got = ld.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for d, t, *_ in rows if d == r.doc_id)
        if t is None:
            assert r.text is None and r.n_lines == 0
            continue
        want = [x for k, x in enumerate(t.split("\n")) if (r.doc_id is not None, r.doc_id or 0, k) not in gone]
        assert r.text == "\n".join(want), r.doc_id
        assert r.n_removed == len(t.split("\n")) - len(want)
    return gone, got


def test_against_all_pairs(spark):
    rows = corpus()
    gone, got = check(spark, rows)
    assert len(gone) > 60 and (True, 94, 0) in gone and (True, 96, 0) in gone
    # columns with the names of helpers stay
    assert {(r.doc, r.drop, r.lines, r._doc) for r in got} == {("y", None, "z", "v"), (None, None, None, None)}


def test_empty(spark):
    assert ld.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_by_edit_similarity(spark):
    # pairs with some changed words, all within the edit distance: the figures that the README states
    rng = random.Random(10)
    words = [f"{rng.randrange(10**7)}" for _ in range(5000)]
    rows, kinds = [], [1] * 400 + [2] * 300 + [3] * 300 + [5] * 300
    for i, changes in enumerate(kinds):
        line = rng.sample(words, rng.randint(8, 120) if changes == 1 else 40)
        other = list(line)
        for k in rng.sample(range(len(line)), changes):
            other[k] = rng.choice(words)
        if changes == 1:
            other[k : k + 1] = rng.choice([[], ["changed"], [line[k], "new"]])
        else:
            assert near(" ".join(line), " ".join(other))
        rows += [(2 * i, " ".join(line), *(None,) * 5), (2 * i + 1, " ".join(other), *(None,) * 5)]
    got = {r.doc_id: r.n_removed for r in ld.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2 * i] == 0 for i in range(len(kinds)))
    found = {c: sum(got[2 * i + 1] for i, k in enumerate(kinds) if k == c) / kinds.count(c) for c in (1, 2, 3, 5)}
    print("recall by changed words", found)
    assert found[1] >= 0.997 and found[2] > 0.25 and found[2] > found[3] > found[5]


def test_permutations_under_one_key(spark):
    # the same words in other orders: all keys in common, most lines far from each other; the twin of each is near
    rng = random.Random(8)
    words = [c * 6 for c in "abcdefghijk"]
    rows = []
    for _ in range(100):
        order = rng.sample(words, 11)
        twin = order[:9] + order[:8:-1]
        rows += [(len(rows), " ".join(order), *(None,) * 5), (len(rows) + 1, " ".join(twin), *(None,) * 5)]
    gone, _ = check(spark, rows)
    assert len(gone) >= 100


def test_similar_is_the_edit_distance(spark):
    rng = random.Random(11)
    words = ["a", "bb", "ccc", "dddd", "é"]
    texts, pairs = [], []
    for i in range(160):
        x = rng.choices(words, k=rng.randint(1, 60))
        y = list(x)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(y))
            y[k : k + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2)) or [""]
        x, y = " ".join(x), " ".join(" ".join(y).split())
        if x and y:
            texts += [(2 * i, x), (2 * i + 1, y)]
            pairs.append((2 * i, 2 * i + 1))
    names = dict(texts)
    sign = lambda w: chr(word_hash(w) & 0x7FFF)
    rows = [(h, t, "".join(map(sign, t.split())), len(t.split()), max(map(len, t.split()))) for h, t in texts]
    got = {(r.a, r.b) for r in ld.similar(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "h long, norm string, codes string, n int, longest int")).collect()}
    want = {(a, b) for a, b in pairs if near(names[a], names[b])}
    assert got == want and 10 < len(want) < 155


def test_normalizing_is_unicode(spark):
    same = ["one two-three it's four", "One\ttwo/three  it’s—four…", "“one two      three it s four”"]
    none = (None,) * 5
    rows = [(i, x + "\n—…", *none) for i, x in enumerate(same)] + [(9, "की", *none), (10, "का", *none)]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: rows[0][1], 1: "—…", 2: "—…", 9: "की", 10: "का"}
    assert re.search("x", normal("X"))


def shuffled(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(10_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_no_one_wants_stay_where_they_are(spark):
    rng = random.Random(12)
    rows = [(i, f"{rng.getrandbits(8000):x} {rng.getrandbits(8000):x}\nlast {i}") for i in range(1000)]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, 1), (None, 0)], "doc long, line_no int")
    before, kept = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [r.norm for r in ld.line_texts(docs, "doc_id", "text", wanted).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == ["last 7"]
    assert shuffled(spark) - before < sum(len(t) for _, t in rows) / 10


def test_perhaps_among_loses_no_key(spark):
    keys = materialize(spark.createDataFrame([(7 * i - 100,) for i in range(5000)] + [(None,)], "doc long"), "keys")
    rows = spark.range(-2000, 60000).selectExpr("id as doc", "'x' as piece").union(spark.createDataFrame([(None, "x")], "doc long, piece string"))
    got = perhaps_among(rows, keys, "doc")
    found = [r.doc for r in got.collect()]
    assert got.columns == ["doc", "piece"] and len(found) == len(set(found)) < 5000 + 57000 / 8
    assert {7 * i - 100 for i in range(5000)} | {None} <= set(found)
    assert perhaps_among(rows, materialize(keys.where("false"), "keys"), "doc").count() == 0
