"""The stages over a small table: each holds on its own input."""

import random
import re

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def corpus():
    rng = random.Random(12)
    common = "the of and to a in is that it for on was with be as at".split()
    words = [*common * 6, *[f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ing" for i in range(300)]]
    make = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, make(40)) for i in range(5)]
    docs = [[i, "\n".join(make(rng.randint(30, 60)) for _ in range(4)), "en"] for i in range(60)]
    docs[7][1] = docs[3][1]  # exact copy
    near = docs[4][1].split(" ")
    near[10] = "changed"
    docs[9][1] = " ".join(near)
    docs[11][1] += "\n" + items[2][1]
    docs.append([70, "A A A A " * 30, "en"])
    docs.append([71, None, "en"])
    docs.append([None, make(80), None])
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in docs], items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    # columns beside those of documents stay, also under names of helpers
    more = spark.createDataFrame([(*r, "m", "g") for r in rows], SCHEMA + ", _lang string, gone string")
    more.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == more.columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert ids - set(kept["quality_rules"]) == {70, 71}
    assert ids - set(kept["line_dedup"]) == {70, 71, 7, 9}  # the copies lost all their lines
    lines = [x for t in kept["line_dedup"].values() for x in t.split("\n")]
    assert len(lines) == len(set(lines))
    texts = list(kept["near_dedup"].values())
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = shingles(a, 5), shingles(b, 5)
            assert 100 * len(x & y) < 80 * len(x | y)
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {11}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {}
    for r in docs.collect():
        packed.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(r.ids, "<u2").tolist()))
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in kept["decontamination"].items()}
    assert {d: [i for _, p in sorted(ps) for i in p] for d, ps in packed.items()} == want
    assert before.count() == len(want)


def test_run_is_the_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows[:12], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 0
