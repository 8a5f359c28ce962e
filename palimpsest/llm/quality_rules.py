"""Quality rules: how far a document's character classes and common words lie from its language's.

Per document two histograms are made: characters by class, and words by a short list of common
words of its language.  The reference of a language is the mean of the histograms of its
documents.  The distance is Jensen-Shannon's (square root of the divergence, base 2).  All of it is
DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

WS = " \t\n\x0b\f\r"
WS_RUN = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"

# Common words of four languages, by frequency.
COMMON_WORDS = {
    "en": "the of and to a in is that it for on was with be as at".split(),
    "de": "der die und in den von zu das sich mit des auf für ist nicht im".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au".split(),
    "es": "de la que el en y del los se las no por un con una es".split(),
}
N_COMMON = 16
CLASSES = ("lower", "upper", "digit", "space", "punct", "symbol", "other")

#: Documents with fewer words than this aren't compared by characters / by words: their histograms are mostly noise.
MIN_WORDS_CHARS = 20
MIN_WORDS_COMMON = 50
#: A distance fails above floor + noise / sqrt(words): a short document's histogram strays that far by chance.
CHAR_FLOOR, CHAR_NOISE = 0.22, 0.6
WORD_FLOOR, WORD_NOISE = 0.19, 0.95
BROADCAST_LANGS = 1000
#: A language with fewer documents than this has no reference; its documents are judged by the base rules alone.
MIN_REFERENCE_DOCS = 20


def _removed(c: Column, part: str) -> Column:
    """How often the one-character ``part`` stands in ``c``."""
    return F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def histograms(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add _trimmed, _words, n_words and the two histograms _chars and _common (arrays of long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    df = docs.withColumns({"_text": body, "_trimmed": F.btrim(body, F.lit(WS)), "_left": F.regexp_replace(body, "[a-z]+", "")})
    df = df.withColumns(
        {
            "_words": F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", WS_RUN)),
            "_n_lower": F.length("_text") - F.length("_left"),
            "_n_left": F.length("_left"),
            "_no_upper": F.regexp_replace("_left", "[A-Z]+", ""),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_n_upper": F.col("_n_left") - F.length("_no_upper"),
            "_n_rest": F.length("_no_upper"),
            "_no_space": F.regexp_replace("_no_upper", WS_RUN, ""),
            # the listed words of any language, two blanks apart: none can overlap the next
            "_padded": F.concat(F.lit(" "), F.array_join(F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(listed)), "  "), F.lit(" ")),
        }
    )
    df = df.withColumns(
        {
            "_n_space": F.col("_n_rest") - F.length("_no_space"),
            "_n_digit": F.length("_no_space") - F.length(F.regexp_replace("_no_space", "[0-9]+", "")),
            "_n_punct": F.length("_no_space") - F.length(F.regexp_replace("_no_space", r"[.,;:!?'\"()\-]+", "")),
            "_n_symbol": F.length("_no_space") - F.length(F.regexp_replace("_no_space", r"[#*$%&|<>@/\\_=+~^`{}\[\]]+", "")),
            "_n_dense": F.length("_no_space"),
        }
    )
    other = F.col("_n_dense") - F.col("_n_digit") - F.col("_n_punct") - F.col("_n_symbol")
    chars = F.array(*[F.col(f"_n_{c}").cast("long") for c in CLASSES[:-1]], other.cast("long"))
    lists = F.create_map(*[x for k, words in COMMON_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(f" {w} ") for w in words]))])
    padded = F.col("_padded")
    common = F.transform(F.element_at(lists, F.col(lang)), lambda w: ((F.length(padded) - F.length(F.replace(padded, w, F.lit("")))) / F.length(w)).cast("long"))
    helpers = ["_left", "_n_lower", "_n_left", "_no_upper", "_n_upper", "_n_rest", "_no_space", "_padded", "_n_space", "_n_digit", "_n_punct", "_n_symbol", "_n_dense"]
    return df.withColumns({"_chars": chars, "_common": common}).drop(*helpers)


def references(hist: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: the mean shares of character classes and of common words.

    Each document of MIN_WORDS_COMMON words or more counts once, so that no long document decides.
    """
    n, m = len(CLASSES), N_COMMON
    shares = hist.where(F.col("n_words") >= MIN_WORDS_COMMON).select(
        F.col(lang).alias("_lang"), _shares(F.col("_chars")).alias("c"), F.transform("_common", lambda x: x / F.col("n_words")).alias("w")
    )
    means = shares.groupBy("_lang").agg(*[F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(n)], *[F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(m)], F.count(F.lit(1)).alias("docs"))
    means = means.where(F.col("docs") >= MIN_REFERENCE_DOCS)
    words = F.when(F.col("w0").isNotNull(), F.array(*[F.col(f"w{i}") for i in range(m)]))
    return means.select("_lang", F.array(*[F.col(f"c{i}") for i in range(n)]).alias("_ref_chars"), words.alias("_ref_common"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / total)


def _with_rest(shares: Column) -> Column:
    """Common words' shares and that of all other words."""
    rest = F.greatest(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return F.concat(shares, F.array(rest))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, 0 to 1."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def repeated_words(words: str, n_words: str, df: DataFrame, out: str, width: int = 8) -> DataFrame:
    """Add ``out``: words that lie in windows of ``width`` (a power of two) words found twice or more in the row's own array."""
    n = F.col(n_words).cast("int")
    # hashes of one word, then by doubling of 2, 4 and 8 words from each place on
    df = df.withColumn("_h", F.when(n > width, F.transform(words, lambda w: F.xxhash64(w))))
    span = 1
    while span < width:
        df = df.withColumn("_h", F.zip_with("_h", F.slice("_h", F.lit(span + 1), n), lambda a, b: F.xxhash64(a, b)))
        span *= 2
    df = df.withColumn("_h", F.slice("_h", F.lit(1), F.greatest(n - (width - 1), F.lit(0))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_p", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_same", F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    zipped = F.arrays_zip(F.col("_p").alias("p"), F.col("_same").alias("nxt"), F.concat(F.array(F.lit(False)), F.col("_same")).alias("prv"))
    starts = F.transform(F.filter(zipped, lambda x: x["p"].isNotNull() & (x["nxt"] | x["prv"])), lambda x: x["p"]["i"])
    df = df.withColumn("_s", F.sort_array(starts))
    steps = F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    covered = F.when(F.col("_s").isNotNull(), F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_p", "_same", "_s")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with the base features and both histograms."""
    df = histograms(docs, text, lang)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _total([_removed(F.col("_text"), s) for s in SYMBOLS]).cast("long"),
            "_lines": lines,
        }
    )
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = repeated_words("_words", "n_words", df, "n_repeat_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_text", "_trimmed", "_words", "_lines")


def judge(found: DataFrame, lang: str = "lang") -> DataFrame:
    """Add both distances and ``kept`` to rows with features."""
    # one row a language; sent to the executors only if they are few, else joined by shuffle
    refs = materialize(references(found, lang), "references")
    if refs.count() <= BROADCAST_LANGS:
        refs = F.broadcast(refs)
    df = found.join(refs, F.col(lang) == F.col("_lang"), "left").drop("_lang")
    own = F.transform("_common", lambda x: x / F.col("n_words"))
    df = df.withColumns(
        {
            "char_distance": F.when(F.col("n_words") >= MIN_WORDS_CHARS, js_distance(_shares(F.col("_chars")), F.col("_ref_chars"))),
            "word_distance": F.when(F.col("n_words") >= MIN_WORDS_COMMON, js_distance(_with_rest(own), _with_rest(F.col("_ref_common")))),
        }
    )
    within = lambda c, floor, noise: F.coalesce(F.col(c) <= floor + noise / F.sqrt("n_words"), F.lit(True))
    near = within("char_distance", CHAR_FLOOR, CHAR_NOISE) & within("word_distance", WORD_FLOOR, WORD_NOISE)
    return df.withColumn("kept", ~F.col("base_failed") & near).drop("_chars", "_common", "_ref_chars", "_ref_common")


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with the base features, both distances, base_failed and kept.

    Null text counts as empty: no words, base_failed.  Rows whose language is null or has too
    little text for a reference, and documents below the length guards, skip the distance checks;
    languages without a list of common words skip the word distance.  Texts of any length count
    whole; repeated rows are judged each and alike; a distance at its bound passes.  An empty table
    gives an empty result.  Columns of the input named like the output's are replaced, all others
    stay, whatever their names.  Features are computed once and written; ``keep_text`` keeps the text.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    kept = [c for c in docs.columns if c in (text, lang) or c not in added]
    others = [c for c in kept if c not in (text, lang)]
    # the other columns travel as one, so that none of them meets a helper column
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None).cast("struct<c:int>")
    found = features(docs.select(packed.alias("packed"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")))
    judged = judge(materialize(found if keep_text else found.drop("text"), "features"))
    own = {c: F.col("packed")[f"c{i}"] for i, c in enumerate(others)} | {text: F.col("text") if keep_text else None, lang: F.col("lang")}
    return judged.select(*[own[c].alias(c) for c in kept if own[c] is not None], *added)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return assess(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LISTS = ", ".join(f"('{k}', [{', '.join(repr(w) for w in words)}])" for k, words in COMMON_WORDS.items())
_SQL_CLASSES = ["a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r".,;:!?''\"()\-", r"#*$%&|<>@/\\_=+~^`{}\[\]"]
ORACLE = rf"""
with lists(lang, listed) as (values {_LISTS}),
w as (select doc_id, d.lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as a, listed from documents d left join lists using (lang)),
f as (
  select doc_id, lang, a, len(a)::bigint as n_words, coalesce(length(array_to_string(a, '')), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::bigint as n_symbols,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines,
    [{", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g'))" for c in _SQL_CLASSES)}] as known, length(t) as n_chars,
    [len([x for x in a if lower(x) = v]) for v in listed] as common
  from w
), s as (
  select doc_id, i, count(*) over (partition by doc_id, array_to_string(a[i:i + 7], ' ')) as times from f, unnest(range(1, len(a) - 6)) r(i)
), r as (
  select doc_id, sum(least(8, coalesce(after - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as after from s where times > 1) group by 1
), g as (
  select f.*, coalesce(r.n, 0)::bigint as n_repeat_words, n_words < 20 or 100 * coalesce(r.n, 0) > 30 * n_words as base_failed,
    [x / n_chars for x in list_append(known, n_chars - list_sum(known))] as chars, [x / n_words for x in common] as words
  from f left join r using (doc_id)
), h as (
  select doc_id, lang, n_words, 'chars' as kind, i, chars[i] as p from g, range(1, {len(CLASSES) + 1}) t(i) where n_words >= {MIN_WORDS_CHARS}
  union all
  select doc_id, lang, n_words, 'words', i, list_append(words, greatest(1 - list_sum(words), 0))[i] from g, range(1, {N_COMMON + 2}) t(i) where n_words >= {MIN_WORDS_COMMON} and words is not null
), refs as (
  select lang, kind, i, avg(p) as q from h where n_words >= {MIN_WORDS_COMMON} group by 1, 2, 3 having count(*) >= {MIN_REFERENCE_DOCS}
), parts as (
  select doc_id, kind, case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end as x from h join refs using (lang, kind, i)
), far as (select doc_id, kind, sqrt(greatest(sum(x) / 2, 0)) as d from parts group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(c.d <= {CHAR_FLOOR} + {CHAR_NOISE} / sqrt(n_words), true) and coalesce(v.d <= {WORD_FLOOR} + {WORD_NOISE} / sqrt(n_words), true) as kept
from g left join (from far where kind = 'chars') c using (doc_id) left join (from far where kind = 'words') v using (doc_id)
"""
