"""Quality rules against a plain version."""

import math
import re
from collections import Counter

from palimpsest.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, kept string, extra string"
EN = "the cat of the house and the dog went to a tree in that place it is for was on with be at as fine words go here "


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def plain_hist(text, lang):
    text = text or ""
    classes = dict.fromkeys(q.CLASSES, 0)
    for ch in text:
        if "a" <= ch <= "z":
            k = "lower"
        elif "A" <= ch <= "Z":
            k = "upper"
        elif "0" <= ch <= "9":
            k = "digit"
        elif ch in q.WS:
            k = "space"
        elif ch in ".,;:!?'\"()-":
            k = "punct"
        elif ch in "#*$%&|<>@/\\_=+~^`{}[]":
            k = "symbol"
        else:
            k = "other"
        classes[k] += 1
    words = [w.lower() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return list(classes.values()), [words.count(w) for w in q.COMMON_WORDS[lang]] if lang in q.COMMON_WORDS else None, len(words)


def distance(p, r):
    total = 0.0
    for a, b in zip(p, r):
        for x, y in ((a, b), (b, a)):
            if x > 0:
                total += x * math.log2(2 * x / (x + y))
    return math.sqrt(max(total / 2, 0))


def docs():
    import random

    rng = random.Random(3)
    vocabulary = EN.split() + [f"w{i}x" for i in range(50)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 300))), "en", None, "e") for i in range(40)]
    rows += [
        (100, "A A A " * 40, "en", None, None),
        (101, None, "en", "x", None),
        (102, "", None, None, None),
        (103, " | ".join(f"zz{i}q" for i in range(120)), "en", None, None),
        (104, " ".join(f"go$$$ no### {i}%%%" for i in range(80)), "en", None, None),
        (105, EN * 12, "en", None, None),
        (106, "line one of text\nline one of text\n \nline one of text\n" + " ".join(f"u{i}" for i in range(30)), "xx", None, None),
        (107, "ä ö\x0bü\x85ß " * 9, None, None, None),
        (100, "A A A " * 40, "en", None, None),
        (108, " ".join(f"v{i % 5000}" for i in range(30000)), "en", None, None),
    ]
    return rows


def test_against_plain(spark):
    rows = docs()
    got = [r.asDict() for r in q.assess(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    refs = {}
    for lang in {r[2] for r in rows if r[2]}:
        hists = [plain_hist(r[1], lang) for r in rows if r[2] == lang]
        hists = [h for h in hists if h[2] >= q.MIN_WORDS_COMMON]
        if len(hists) >= q.MIN_REFERENCE_DOCS:
            mean = lambda rows: [sum(c) / len(rows) for c in zip(*rows)]
            refs[lang] = mean([[c / sum(h[0]) for c in h[0]] for h in hists]), mean([[c / h[2] for c in h[1]] for h in hists]) if lang in q.COMMON_WORDS else None
    by_id = {r[0]: r for r in rows}
    for g in got:
        _, text, lang, *_ = by_id[g["doc_id"]]
        n, *rest = plain(text)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (n, *rest), g["doc_id"]
        failed = n < 20 or 100 * rest[-1] > 30 * n
        assert g["base_failed"] == failed
        keep = not failed
        if lang in refs:
            chars, common, _ = plain_hist(text, lang)
            if n >= q.MIN_WORDS_CHARS:
                d = distance([c / sum(chars) for c in chars], refs[lang][0])
                assert abs(d - g["char_distance"]) < 1e-9
                keep &= d <= q.CHAR_FLOOR + q.CHAR_NOISE / math.sqrt(n)
            if n >= q.MIN_WORDS_COMMON and common is not None:
                p, r = [c / n for c in common], refs[lang][1]
                d = distance([*p, 1 - sum(p)], [*r, 1 - sum(r)])
                assert abs(d - g["word_distance"]) < 1e-9
                keep &= d <= q.WORD_FLOOR + q.WORD_NOISE / math.sqrt(n)
        assert g["kept"] == keep, g
    kept = {g["doc_id"] for g in got if g["kept"]}
    assert set(range(40)) <= kept and not kept & {100, 101, 102, 103, 104, 105}
    assert "extra" in got[0] and "text" in got[0]


def test_clashing_names(spark):
    names = ["doc_id", "text", "lang", "_lang", "_text", "_words", "packed", "_chars"]
    rows = [(i, EN * 3, "en", f"a{i}", "b", "c", "d", "e") for i in range(3)]
    got = q.assess(spark.createDataFrame(rows, names))
    assert got.columns[:8] == names and sorted(tuple(r)[:8] for r in got.collect()) == rows


def test_empty(spark):
    assert q.assess(spark.createDataFrame([], SCHEMA)).count() == 0
