"""Decontamination against brute force."""

import random
import re

from palimpsest.llm import decontamination as dc

DOCS = "doc_id long, text string, item_id string, containment string"
ITEMS = "item_id long, text string, doc_id string"


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def tables():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 80))), "x") for i in range(30)]
    items += [(100, None, None), (101, "", None), (None, "null id item has these words", None), (3, items[3][1], "again")]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").split()
            if item and rng.random() < 0.5:
                item[rng.randrange(len(item))] = "changed"
            parts.insert(rng.randint(0, 1), " ".join(item).upper() if rng.random() < 0.3 else "\n".join(item))
        docs.append((i, " ".join(parts), "a", None))
    docs += [(None, items[5][1], None, None), (500, None, None, None), (501, "", None, None), docs[7]]
    docs.append((502, " ".join(rng.choices(words, k=40000)) + " " + items[8][1], None, None))
    return docs, items


def test_against_brute_force(spark):
    docs, items = tables()
    want = []
    for d, text, *_ in docs:
        by_width = {w: shingles(text, w) for w in range(1, 6)}
        for i, item, *_ in items:
            own = shingles(item, 5)
            if own:
                width = len(next(iter(own)))
                got = by_width[width]
                if got and len(next(iter(got))) == width and 5 * len(own & got) >= 4 * len(own):
                    want.append((d, i, len(own), len(own & got)))
    found = dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found), key=str) == sorted(want, key=str)
    assert len(want) > 30
    kept = dc.drop_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    leaked = {w[0] for w in want}
    assert sorted((r.doc_id for r in kept), key=str) == sorted((d[0] for d in docs if d[0] not in leaked), key=str)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(dc, "BLOCK_SHINGLES", 100)
    many = dc.find_leaks(spark.createDataFrame(docs[:60], DOCS), spark.createDataFrame(items, ITEMS)).count()
    monkeypatch.setattr(dc, "BLOCK_SHINGLES", 10**6)
    assert many == dc.find_leaks(spark.createDataFrame(docs[:60], DOCS), spark.createDataFrame(items, ITEMS)).count() > 0


def test_empty(spark):
    docs, items = tables()
    assert dc.find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert dc.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert dc.drop_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == len(docs)


def test_hits_needed():
    assert dc.hits_needed(1) == 1 and dc.hits_needed(10) == 8 and 1 < dc.hits_needed(1000) < 8
