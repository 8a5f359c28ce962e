"""Katz scores against a plain model, and its normalisation."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest
from palimpsest.llm import katz

SCHEMA = "doc_id long, text string, score string, key string"


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*[w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], "\n"]


class Plain:
    def __init__(self, rows):
        self.train = [tokens(t) for d, t, *_ in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
        self.c, self.cc = Counter(), defaultdict(Counter)
        for t in self.train:
            self.c.update(t)
            for h, w in zip(["\n\n", *t], t):
                self.cc[h][w] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        count = lambda xs: [sum(x == k for x in xs) for k in range(1, katz.K + 2)]
        uni, bi = count(self.c.values()), count([x for f in self.cc.values() for x in f.values()])
        self.d = katz.Discounts([self.n, self.v, *uni, *bi])

    def p1(self, w):
        return self.d.word(self.c[w])

    def p(self, w, h):
        seen = self.cc.get(h)
        if not seen:
            return self.p1(w)
        star = lambda r: self.d.bi[r - 1] if r <= katz.K else r - katz.RESERVE
        c = sum(seen.values())
        if w in seen:
            return star(seen[w]) / c
        return (1 - sum(map(star, seen.values())) / c) / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def score(self, text):
        t = tokens(text)
        return sum(log10(self.p(w, h)) for h, w in zip(["\n\n", *t], t))

    def base(self, text):
        return sum(log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(6000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 90))).replace("w1 ", "The "), "x", None) for i in range(220)]
    same = "seven words that always follow each other"
    rows += [(1000 + i, same, None, None) for i in range(30)]
    rows += [(None, "null id  text", None, None), (2000, None, None, None), (2001, "", None, None), (3, rows[3][1], None, None), (2002, "é É\x0bÜ \x85 x", None, None)]
    rows.append((2003, " ".join(rng.choices(vocabulary, k=30000)), None, None))
    return rows


@pytest.mark.parametrize("split", [256, 10**9])
def test_against_plain(spark, monkeypatch, split):
    monkeypatch.setattr(katz, "SPLIT", split)
    rows = corpus()
    model = Plain(rows)
    got = katz.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(rows)
    for r, (d, text, *_) in zip(sorted(got, key=key), sorted(rows, key=key)):
        t = tokens(text)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, d is not None and zlib.crc32(str(d).encode()) % 5 == 1, len(t), sum(model.c[w] > 0 for w in t), model.n)
        assert r.base_score == pytest.approx(model.base(text), rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(model.score(text), rel=1e-9, abs=1e-6)


def test_normalised():
    model = Plain(corpus())
    assert sum(map(model.p1, model.c)) + model.d.unknown == pytest.approx(1, abs=1e-12)
    for h in [*random.Random(1).sample(sorted(model.cc), 40), "\n\n", "follow", "never seen"]:
        assert sum(model.p(w, h) for w in model.c) + model.p("unknown word", h) == pytest.approx(1, abs=1e-10)
    assert model.d.bi[0] < 1 and model.d.uni[0] < 1


def test_better_than_base_on_held_out():
    rng = random.Random(3)
    follow = {f"a{i}": [f"a{rng.randrange(50)}" for _ in range(3)] for i in range(50)}
    rows = []
    for i in range(400):
        w = ["a0"]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    model = Plain(rows)
    held = [t for d, t in rows if zlib.crc32(str(d).encode()) % 5 == 1]
    assert sum(map(model.score, held)) > sum(map(model.base, held)) + 100


def test_empty_and_untrained(spark):
    assert katz.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = katz.score_documents(spark.createDataFrame([(only, "a b", None, None)], SCHEMA)).first()
    assert r.held_out and r.n_known == 0 and r.score == 0
