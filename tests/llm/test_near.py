"""Near-dedup against all pairs, and components against a plain union-find."""

import random
import re

from palimpsest.llm import common
from palimpsest.llm import near_dedup as nd
from palimpsest.llm.common import connected_components

SCHEMA = "doc_id long, text string, n string, sig string"


def shingles(text, width):
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    words = [w for w in words if w]
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def union(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [" ".join(rng.choices(words, k=rng.randint(2, 200))) for _ in range(40)]
    for i in range(300):
        text = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(text) // 12))):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).upper() if rng.random() < 0.2 else "\n".join(text), "x", None))
    family = base[0].split() * 2
    for i in range(80):  # more close copies than a small node holds
        text = list(family)
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 + i, " ".join(text), None, None))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, " \n", None, None), (2003, "One", None, None), (2004, "one", None, None), (None, "one", None, None), (5, rows[5][1], "x", None)]
    rows.append((3000, " ".join(rng.choices(words, k=30000)), None, None))
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    for width in (2, 5):
        sets = {d: shingles(t, width) for d, t, *_ in rows if d is not None}
        ids = sorted(sets)
        edges = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        roots = union(ids, edges)
        want = sorted(((d, len(shingles(t, width)), roots.get(d), d is None or roots[d] == d) for d, t, *_ in rows), key=str)
        got = nd.components(spark.createDataFrame(rows, SCHEMA), width=width).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == want
    kept = nd.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((w[0] for w in want if w[3]), key=str)


def test_empty(spark):
    assert nd.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(400 + i, 401 + i) for i in range(60)] + [(7, 7)] + [(500, 500 + i) for i in range(1, 50)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = union({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for n in nodes}


def test_components_of_one_task(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(401 + i, 400 + i) for i in range(60)] + [(7, 7), (None, 3)]
    want = union({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    df = spark.createDataFrame(edges, "a long, b long")
    for one_task in (1000, 100, 1):  # all edges, what is left after some steps, and none
        got = {r.node: r.component for r in connected_components(df, one_task).collect()}
        assert got == {n: want[n] for e in edges if None not in e and e[0] != e[1] for n in e}


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_jobs_of_a_small_table(spark):
    # components of few edges cost no round of jobs for each step
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(words, 45)), None, None) for i in range(300)]
    chain = [f"c{i}" for i in range(140)]
    rows += [(1000 + i, " ".join(chain[i : i + 60]), None, None) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert jobs_of(spark, lambda: nd.components(df, width=1).collect()) <= 110


def template_rows(twins):
    # 85 words of a template and 15 own: partners share four of those (89 of 111), all others are at 85 of 115
    template = [f"t{i}" for i in range(85)]
    return [(2 * i + k, " ".join(template + [f"p{i}x{j}" for j in range(4)] + [f"o{i}x{k}x{j}" for j in range(11)]), None, None) for i in range(twins) for k in (0, 1)]


def test_recall(spark):
    # a large family, and pairs at the threshold, each alone: 40 words in common and 5 own
    rng = random.Random(6)
    rows = template_rows(1000)
    for i in range(1000, 2000):
        shared = [f"s{rng.randrange(10**9)}" for _ in range(40)]
        rows += [(2 * i + k, " ".join(shared + [f"q{i}x{k}x{j}" for j in range(5)]), None, None) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in nd.components(spark.createDataFrame(rows, SCHEMA).repartition(4), width=1).collect()}
    assert all(c in (d, d - d % 2) for d, c in got.items())
    missed = [i for i in range(2000) if got[2 * i + 1] != 2 * i]
    assert sum(i < 1000 for i in missed) <= 10 and sum(i >= 1000 for i in missed) <= 10


def test_family_comparison_finds_every_component(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = {d: " ".join(rng.sample(words, 45)) for d in range(120)}
    sets = {d: shingles(t, 1) for d, t in texts.items()}
    edges = [(a, b) for a in texts for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(set(union(texts, edges).values())) not in (1, 120)
    members = spark.createDataFrame([(d, d, 0, True) for d in texts], "doc long, component long, family long, minor boolean")
    old, nd.BLOCK_BYTES = nd.BLOCK_BYTES, 9000
    try:
        links = nd.family_links(members, spark.createDataFrame(list(texts.items()), "doc long, text string"), 1, 80).collect()
    finally:
        nd.BLOCK_BYTES = old
    assert union(texts, [(r.a, r.b) for r in links]) == union(texts, edges)


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, _gone string")
    assert [tuple(r) for r in nd.drop_near_duplicates(df).collect()] == [rows[0]]


def test_join_groups(spark):
    rows = [(0 if i % 3 else i, i) for i in range(600)]
    counts = {}
    for k, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    groups = spark.createDataFrame([(k, n, k * 2) for k, n in counts.items()], "k long, n long, v long")
    old, common.HEAVY, common.ONE_TASK = (common.HEAVY, common.ONE_TASK), 10, 0
    try:
        got = sorted((r.k, r.i, r.v) for r in common.join_groups(spark.createDataFrame(rows, "k long, i long"), groups, "k").collect())
    finally:
        common.HEAVY, common.ONE_TASK = old
    assert got == sorted((k, i, 2 * k) for k, i in rows)


def test_forest_joins_as_all_links_do():
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    for bound in (3, 1000):
        forest, told = nd.Forest(bound), []
        for a, b in links:
            if forest.root(a) != forest.root(b):
                forest.join(a, b)
                told.append((a, b))
        assert union(range(60), told) == union(range(60), links)
        assert bound == 3 or len(told) == 60 - len(set(union(range(60), links).values()))
