"""The registered queries on the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import similarity as sim
from palimpsest.functions import text as tx
from palimpsest.operators import align as al
from palimpsest.operators import diff as df_
from palimpsest.operators import moves as mv
from palimpsest.plans import compare as cmp
from palimpsest.schema import LIMITS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _units(spark, sf) -> DataFrame:
    return cmp.document_units(_read(spark, sf, "documents"))


def _pairs(spark, sf) -> DataFrame:
    return cmp.shared_line_pairs(_read(spark, sf, "documents"))


UNITS = r"""
units as (
  select doc_id, (i - 1)::int as unit_index, case when contains(l, ' | ') then 'table-row' else 'paragraph' end as kind, l as text,
    case when contains(l, ' | ') then string_split(l, ' | ') end as cells
  from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)
)"""
LINE_PAIRS = r"""
lines as (select distinct doc_id as d, l from (select doc_id, unnest(string_split(text, chr(10))) as l from documents where text is not null) where trim(l, ' ') <> ''),
few as (select l from lines group by l having count(*) between 2 and 5),
pairs as (select distinct a.d as before, b.d as after from lines a join few using (l) join lines b using (l) where a.d < b.d)"""
PRINTS = r"""
prints as (
  select doc_id, unit_index, kind || chr(0) || case when cells is null then 'p' || length(text) || ':' || text
    else 't' || len(cells) || ':' || array_to_string(list_transform(cells, lambda c: length(c) || ':' || c), '') end as print
  from units
)"""
SIDES = r"""
sided as (
  select before || '-' || after as pair_id, 'before' as side, u.* from pairs join units u on u.doc_id = before
  union all select before || '-' || after, 'after', u.* from pairs join units u on u.doc_id = after
)"""


# ---- units and scalar functions


@query(f"with {UNITS} select doc_id, unit_index, kind, text, cells from units")
def unit_extract(spark, sf):
    """Documents to ordered units with cells."""
    return _units(spark, sf)


@query(f"with {UNITS} select kind, count(*) as units, sum(coalesce(len(cells), 0))::bigint as cells from units group by kind")
def unit_kind_counts(spark, sf):
    return _units(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("units"), F.sum(F.coalesce(F.size("cells"), F.lit(0))).alias("cells"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[3:greatest(2, len(string_split(text, chr(10))) - 1)], chr(10)) as trimmed from documents")
def trim_header_footer(spark, sf):
    """Without two header lines and one footer line."""
    return _read(spark, sf, "documents").select("doc_id", tx.omit_lines(F.col("text"), 2, 1).alias("trimmed"))


@query(r"select page_id, regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]', chr(65533), 'g') as clean from pages")
def sanitize_text(spark, sf):
    return _read(spark, sf, "pages").select("page_id", tx.extracted_text(F.col("html")).alias("clean"))


@query(r"""select page_id, coalesce(nullif(left(trim(regexp_replace(string_split_regex(url, '[\\/]')[-1], '[\x00-\x1F\x{7F}-\x{9F}]', '', 'g')), 120), ''), 'Untitled document') as name from pages""")
def sanitize_name(spark, sf):
    return _read(spark, sf, "pages").select("page_id", tx.display_name(F.col("url")).alias("name"))


@query(r"""select page_id, coalesce(nullif(left(trim(regexp_replace(string_split_regex(url, '[\\/]')[-1], '[\x00-\x1F\x7F]', '_', 'g')), 120), ''), 'Untitled document') as name from pages""")
def batch_safe_name(spark, sf):
    return _read(spark, sf, "pages").select("page_id", tx.batch_name(F.col("url")).alias("name"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from pages""")
def html_escape(spark, sf):
    return _read(spark, sf, "pages").select("page_id", tx.html_escape(F.col("html")).alias("escaped"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') as decoded from pages""")
def entity_decode(spark, sf):
    return _read(spark, sf, "pages").select("page_id", tx.entity_decode(F.col("html")).alias("decoded"))


@query(f"""with {UNITS} select doc_id, unit_index, case kind when 'paragraph' then 'Paragraph ' || (unit_index + 1) else 'Table 1, row ' || (unit_index + 1) end as label from units""")
def location_label(spark, sf):
    return _units(spark, sf).select("doc_id", "unit_index", tx.location_label(F.col("kind"), F.col("unit_index"), F.lit(0), F.col("unit_index")).alias("label"))


@query("select doc_id, sha256(text) as sha256, strlen(text)::int as bytes from documents")
def sha256_identity(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


@query("select min(doc_id) as first_doc, count(*) as copies from documents where text is not null group by sha256(text) having count(*) > 1")
def identical_documents(spark, sf):
    """Documents with one identity, by it."""
    docs = _read(spark, sf, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("h")


@query("select page_id, case when lower(url) like '%.docx' then 'docx' when lower(url) like '%.pdf' then 'pdf' end as format from pages")
def format_detection(spark, sf):
    return _read(spark, sf, "pages").select("page_id", tx.format_of(F.col("url")).alias("format"))


@query("select doc_id, case when regexp_full_match(lang || '_X', '[A-Z0-9_]{1,64}') then lang || '_X' else 'COMPARE_FAILED' end as code, left(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), 240) as message from documents")
def safe_error(spark, sf):
    """Error envelopes: unknown codes are replaced, messages bounded."""
    docs = _read(spark, sf, "documents")
    return docs.select("doc_id", tx.safe_error_code(F.concat("lang", F.lit("_X"))).alias("code"), tx.safe_error_message(F.col("text")).alias("message"))


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then null else list_distinct_ordered end as pages from (
  select o_orderkey, case when o_custkey % 250 + 1 <= 200 then case when o_custkey % 250 = o_orderkey % 200 then [(o_custkey % 250)::int] else [(o_custkey % 250)::int, (o_orderkey % 200)::int] end end as list_distinct_ordered from orders)""")
def ocr_page_list(spark, sf):
    """Page selections written as text to page indexes."""
    orders = _read(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("1, x")).otherwise(F.concat((F.col("o_custkey") % 250 + 1).cast("string"), F.lit(", "), (F.col("o_orderkey") % 200 + 1).cast("string"), F.lit(",")))
    return orders.select("o_orderkey", tx.page_list(text).alias("pages"))


# ---- tokens and similarity


@query(r"with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as token from documents) select doc_id, token, count(*) as n from t group by 1, 2")
def token_counts(spark, sf):
    return sim.token_counts(_read(spark, sf, "documents"), ["doc_id"])


_DICE = r"""
t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as token from documents),
c as (select doc_id, token, count(*) as n from t group by 1, 2),
z as (select doc_id, sum(n) as size from c group by 1),
s as (select before, after, sum(least(a.n, b.n)) as shared from pairs join c a on a.doc_id = before join c b on b.doc_id = after and a.token = b.token group by 1, 2)
"""


@query(f"""with {LINE_PAIRS}, {_DICE} select p.before, p.after, round(case when coalesce(x.size, 0) + coalesce(y.size, 0) = 0 then 1.0 else 2.0 * coalesce(shared, 0) / (coalesce(x.size, 0) + coalesce(y.size, 0)) end, 6)::double as dice
from pairs p left join z x on x.doc_id = p.before left join z y on y.doc_id = p.after left join s on s.before = p.before and s.after = p.after""")
def token_dice_pairs(spark, sf):
    counts = sim.token_counts(_read(spark, sf, "documents"), ["doc_id"])
    return sim.dice_pairs(_pairs(spark, sf), counts, "before", "after", "doc_id").select("before", "after", F.round("dice", 6).alias("dice"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: round((x + 1) * 127.5)) as s from embeddings)
select a.vec_id, round(greatest(0, 1 - list_sum(list_transform(list_zip(a.s, b.s), lambda p: abs(p[1] - p[2]))) / len(a.s) / 255), 6)::double as similarity
from e a join e b on b.vec_id = a.vec_id + 1""")
def sample_similarity(spark, sf):
    """Grayscale-like samples of neighbouring vectors."""
    e = _read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 127.5)).alias("s"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("o"))
    return e.join(b, "vec_id").select("vec_id", F.round(sim.sample_similarity(F.col("s"), F.col("o")), 6).alias("similarity"))


@query(f"""with {LINE_PAIRS}, {_DICE}, d as (
  select p.before, p.after, case when coalesce(x.size, 0) + coalesce(y.size, 0) = 0 then 1.0 else 2.0 * coalesce(shared, 0) / (coalesce(x.size, 0) + coalesce(y.size, 0)) end as dice
  from pairs p left join z x on x.doc_id = p.before left join z y on y.doc_id = p.after left join s on s.before = p.before and s.after = p.after)
select before, after, round(case when trim(a.text) = '' and trim(b.text) = '' then 0.5 when trim(a.text) = '' or trim(b.text) = '' then 0.45 else least(1.0, 0.86 * dice + 0.07) end, 6)::double as similarity
from d join documents a on a.doc_id = before join documents b on b.doc_id = after""")
def unit_similarity(spark, sf):
    """Whole documents as units, with half-alike samples."""
    docs = _read(spark, sf, "documents")
    counts = sim.token_counts(docs, ["doc_id"])
    d = sim.dice_pairs(_pairs(spark, sf), counts, "before", "after", "doc_id")
    d = d.join(docs.select(F.col("doc_id").alias("before"), F.col("text").alias("ta")), "before").join(docs.select(F.col("doc_id").alias("after"), F.col("text").alias("tb")), "after")
    return d.select("before", "after", F.round(sim.unit_similarity(F.col("ta"), F.col("tb"), F.col("dice"), F.lit(0.5)), 6).alias("similarity"))


# ---- fingerprints, anchors, moves


@query(f"with {UNITS}, {PRINTS} select print, count(*) as n from prints group by print")
def fingerprint_counts(spark, sf):
    return _units(spark, sf).select(tx.fingerprint(F.col("kind"), F.col("text"), F.col("cells")).alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name, ''), lambda c: unicode(c)::bigint)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)) as hash from part""")
def fnv1a32(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", tx.fnv1a32(F.col("p_name")).alias("hash"))


def _revision_units(spark, sf) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return cmp.revision_units(docs, cmp.shared_line_pairs(docs))


_SIDED_PRINTS = f"""{UNITS}, {LINE_PAIRS}, {PRINTS},
one as (
  select before || '-' || after as pair_id, side, print, count(*) as n, min(unit_index) as unit_index from (
    select before, after, 'before' as side, p.* from pairs join prints p on p.doc_id = before
    union all select before, after, 'after', p.* from pairs join prints p on p.doc_id = after)
  group by before, after, side, print
)"""


@query(f"with {_SIDED_PRINTS} select b.pair_id, b.unit_index as before_idx, a.unit_index as after_idx from one b join one a on a.pair_id = b.pair_id and a.print = b.print where b.side = 'before' and a.side = 'after' and a.n = 1 and b.n = 1")
def unique_anchors(spark, sf):
    return al.unique_anchors(al.with_fingerprints(_revision_units(spark, sf)))


@query(f"with {_SIDED_PRINTS} select pair_id, side, count(*) as prints, sum(n)::bigint as units from one where n > 1 group by pair_id, side")
def ambiguous_repeats(spark, sf):
    """Fingerprints that can't anchor or move: they recur on their side."""
    counts = al.print_counts(al.with_fingerprints(_revision_units(spark, sf))).where("n > 1")
    return counts.groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("prints"), F.sum("n").alias("units"))


@query(f"""with {_SIDED_PRINTS} select b.pair_id, b.unit_index as before_idx, a.unit_index as after_idx from one b join one a on a.pair_id = b.pair_id and a.print = b.print
where b.side = 'before' and a.side = 'after' and a.n = 1 and b.n = 1 and a.unit_index <> b.unit_index""")
def exact_move_candidates(spark, sf):
    """Unique fingerprints at another place, with every unit in a row of its own."""
    units = _revision_units(spark, sf).select("pair_id", "side", "unit_index", "kind", "text", "cells", F.col("unit_index").alias("row_seq"), F.lit(True).alias("alone"))
    return mv.exact_moves(units).where("from_idx <> to_idx").select("pair_id", F.col("from_idx").alias("before_idx"), F.col("to_idx").alias("after_idx"))


_SHUFFLED = """l as (
  select l_orderkey::varchar as pair_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1)::int as i,
    (count(*) over (partition by l_orderkey))::int as n, [l_returnflag, l_linestatus, l_quantity::int::varchar] as cells from lineitem),
r as (
  select pair_id, i + 1 as row_seq, i as b, case when i % 3 <> 1 then n + i end as a, cells from l
  union all select pair_id, n + i + 1, null, 2 * n + i, cells from l where i % 3 = 1 and i % 2 = 1),
p as (select *, 't3:' || array_to_string(list_transform(cells, lambda c: length(c) || ':' || c), '') as print from r),
one as (select pair_id, print, max(row_seq) filter (a is null) as gone, max(b) filter (a is null) as old, max(row_seq) filter (b is null) as come, max(a) filter (b is null) as new
  from p group by 1, 2 having count(b) = 1 and count(a) = 1 and gone is not null and come is not null),
m as (select *, 'move-' || printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_concat(list_transform(string_split('table-row', ''), lambda c: unicode(c)::bigint), [0::bigint],
  list_transform(string_split(print, ''), lambda c: unicode(c)::bigint))), lambda h, u: (xor(h, u) * 16777619) & 4294967295)) || '-' || old || '-' || new as move_id from one)"""


@query(f"""with {_SHUFFLED} select r.pair_id, r.row_seq, coalesce(m.move_id, 'block-' || r.row_seq) as row_id, case when m.move_id is not null then 'moved' when r.a is null then 'removed' when r.b is null then 'added' else 'unchanged' end as status,
  coalesce(m.old, r.b) as before_idx, r.a as after_idx, m.move_id, len(r.cells)::int as cells, case when m.move_id is null and (r.a is null or r.b is null) then 3 else 0 end as changed_cells
from r left join m on m.pair_id = r.pair_id and m.come = r.row_seq where not exists (select 1 from m g where g.pair_id = r.pair_id and g.gone = r.row_seq)""")
def move_reclassification(spark, sf):
    """Orders as documents of table rows: every third item is removed at its place, the first of those added at the end; moves by text."""
    li = _read(spark, sf, "lineitem")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cells = F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    items = li.select(F.col("l_orderkey").cast("string").alias("pair_id"), (F.row_number().over(own) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).cast("int").alias("n"), cells.alias("c"))
    i, n, none = F.col("i"), F.col("n"), F.lit(None).cast("int")
    place = lambda seq, b, a: F.struct(seq.alias("row_seq"), b.alias("before_idx"), a.alias("after_idx"))
    first = place(i + 1, i, F.when(i % 3 != 1, n + i))
    rows = items.select("pair_id", "c", F.inline(F.when((i % 3 == 1) & (i % 2 == 1), F.array(first, place(n + i + 1, none, 2 * n + i))).otherwise(F.array(first))))
    left, right = F.col("before_idx").isNotNull(), F.col("after_idx").isNotNull()
    word = F.when(left & right, "equal").when(left, "removed").otherwise("added")
    cell = lambda x, i: F.struct(F.when(left, i).alias("before_cell"), F.when(right, i).alias("after_cell"), F.array(F.struct(word.alias("kind"), x.alias("text"))).alias("changes"))
    line = F.array_join("c", "\t")
    rows = rows.select(
        "pair_id", "row_seq", F.concat(F.lit("block-"), F.col("row_seq").cast("string")).alias("row_id"), F.when(left & right, "unchanged").when(left, "removed").otherwise("added").alias("status"), "before_idx", "after_idx",
        *[F.when(has, x).alias(f"{s}_{name}") for s, has in (("before", left), ("after", right)) for name, x in (("kind", F.lit("table-row")), ("text", line), ("cells", F.col("c")))],
        df_.single_change(line, "equal").alias("changes"), F.transform("c", cell).alias("cell_changes"), F.lit(None).cast("string").alias("move_id"),
    )
    moved = mv.reclassify_moves(rows)
    return moved.select("pair_id", "row_seq", "row_id", "status", "before_idx", "after_idx", "move_id", F.size("cell_changes").alias("cells"), df_.changed_cells(F.col("cell_changes")).alias("changed_cells"))


@query("select doc_id, case when trim(regexp_replace(text, '[\\s\\p{Z}]', '', 'g')) = '' then 'none' else 'pdf-text' end as source from documents")
def blank_evidence(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", tx.text_evidence(F.col("text")).alias("source"))


# ---- cells, budgets, summaries


@query("""with l as (select l_orderkey, l_linenumber, [l_returnflag, l_linestatus, l_quantity::int::varchar] as cells from lineitem),
p as (select a.l_orderkey, a.l_linenumber, a.cells as x, b.cells as y from l a join l b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
c as (select l_orderkey, l_linenumber, x, y, unnest(range(1, 4)) as i from p)
select l_orderkey, l_linenumber, (i - 1)::int as cell, x[i] as before, y[i] as after, x[i] <> y[i] as changed from c""")
def cell_positional_diff(spark, sf):
    """Neighbouring line items as table rows: cells by position."""
    li = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("x"))
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("x").alias("y"))
    cells = li.join(nxt, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.explode(df_.cell_pairs(F.col("x"), F.col("y"))).alias("c"))
    return cells.select("l_orderkey", "l_linenumber", F.coalesce("c.before_cell", "c.after_cell").alias("cell"), "c.before", "c.after", (F.col("c.before") != F.col("c.after")).alias("changed"))


@query(f"""with {UNITS} select doc_id, unit_index, (sum(length(text)) over (partition by doc_id order by unit_index))::bigint as chars,
(sum(length(text)) over (partition by doc_id order by unit_index)) > 2000000 or length(text) > 100000 as over_limit from units""")
def budget_running(spark, sf):
    """Running text budget within a document."""
    own = Window.partitionBy("doc_id").orderBy("unit_index")
    chars = F.sum(tx.utf16_length(F.col("text")).cast("long")).over(own)
    return _units(spark, sf).select("doc_id", "unit_index", chars.alias("chars"), ((chars > LIMITS["total_chars"]) | (tx.utf16_length(F.col("text")) > LIMITS["unit_chars"])).alias("over_limit"))


_EVENT_ROWS = "select user_id, row_number() over (partition by user_id order by event_id) as row_seq, case event_type when 'click' then 'changed' when 'purchase' then 'added' when 'view' then 'unchanged' else 'removed' end as status from events"


def _event_rows(spark, sf) -> DataFrame:
    e = _read(spark, sf, "events")
    status = F.when(F.col("event_type") == "click", "changed").when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "view", "unchanged").otherwise("removed")
    return e.select(F.col("user_id").alias("pair_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("row_seq"), status.alias("status"))


@query(f"""with r as ({_EVENT_ROWS}) select user_id as pair_id, count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'changed') as changed,
count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, count(*) filter (status = 'moved') as moved from r group by user_id""")
def status_summary(spark, sf):
    """Counts by status, one event as one row."""
    return mv.summarize(_event_rows(spark, sf)).select("pair_id", "unchanged", "changed", "added", "removed", "moved")


@query(f"""with r as ({_EVENT_ROWS}) select user_id as pair_id, case when count(*) filter (status <> 'unchanged') > 0 then 'changed' when user_id % 3 <> 0 then 'identical' else 'uncertain' end as outcome,
case when user_id % 3 <> 0 then 'complete' else 'incomplete' end as certainty from r group by user_id""")
def outcome(spark, sf):
    """Outcomes where every third pair has a warning."""
    rows = _event_rows(spark, sf)
    warned = rows.where("pair_id % 3 = 0").select("pair_id").distinct().select("pair_id", F.array(F.lit("a warning"), F.lit("a warning")).alias("warnings"))
    return mv.summarize(rows, warned).select("pair_id", "outcome", "certainty")


@query(f"with r as ({_EVENT_ROWS}) select user_id as pair_id, min(row_seq)::int as first_change from r where status <> 'unchanged' group by user_id")
def first_change(spark, sf):
    return mv.summarize(_event_rows(spark, sf)).where("first_change is not null").select("pair_id", "first_change")


@query("""select event_id, user_id, next from (select event_id, user_id, event_type, coalesce(lead(event_id) over (partition by user_id order by event_id), first_value(event_id) over (partition by user_id order by event_id)) as next from events where event_type <> 'view')""")
def next_change(spark, sf):
    """The next changed row, around the end to the first."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = _read(spark, sf, "events").where("event_type <> 'view'")
    return e.select("event_id", "user_id", F.coalesce(F.lead("event_id").over(own), F.first("event_id").over(own)).alias("next"))


@query(f"with r as ({_EVENT_ROWS}) select user_id, row_seq::int as row_seq, status from r where status <> 'unchanged'")
def changes_only(spark, sf):
    """The view of differences."""
    return _event_rows(spark, sf).where("status <> 'unchanged'").withColumnRenamed("pair_id", "user_id")


# ---- inputs and geometry


@query("""select page_id, strlen(html)::bigint as bytes, case when strlen(html) = 0 then 'INVALID_INPUT' when strlen(html) > 52428800 then 'INPUT_TOO_LARGE' when length(url) > 1024 then 'INVALID_INPUT'
when not contains(left(html, 1024), 'PDF-') then 'PDF_DECODE_FAILED' end as error from pages""")
def input_validation(spark, sf):
    """Page bytes against the rules for PDF inputs."""
    from palimpsest.sources.inputs import validate

    pages = _read(spark, sf, "pages").select("page_id", F.col("url").alias("name"), F.col("html").cast("binary").alias("content"))
    return validate(pages, version=1).select("page_id", F.octet_length("content").cast("long").alias("bytes"), F.col("error.code").alias("error"))


@query("""select a.page_id, case when strlen(a.html) + strlen(b.html) > 20000 then 'INPUT_TOO_LARGE' end as error from pages a join pages b on b.page_id = a.page_id + 1""")
def pair_validation(spark, sf):
    """Combined size of neighbouring pages against a small limit."""
    from palimpsest.sources.inputs import pair_error

    pages = _read(spark, sf, "pages").select("page_id", F.octet_length("html").alias("n"))
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("n").alias("m"))
    return pages.join(nxt, "page_id").select("page_id", pair_error(F.col("n"), F.col("m"), 20_000).alias("error"))


@query("""select l_orderkey, l_linenumber, round(least(1.5, 1200 / greatest(a, c), 1600 / greatest(b, d)), 9)::double as scale from
(select l_orderkey, l_linenumber, l_quantity * 50 as a, l_extendedprice as b, l_quantity * 30 + 500 as c, l_extendedprice / 2 + 400 as d from lineitem)""")
def pair_scale(spark, sf):
    """Render scale at which both pages of a pair fit."""
    from palimpsest.operators.raster import fit_scale

    li = _read(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", F.round(fit_scale(F.greatest(q * 50, q * 30 + 500), F.greatest(p, p / 2 + 400)), 9).alias("scale"))


_ITEMS = "select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as seq, l_returnflag || l_linestatus as str, (l_linenumber * 10 + l_quantity)::double as x, (l_tax * 100)::double as y, 12.0::double as width, (1 + l_discount * 50)::double as font_size, l_linenumber % 5 = 0 as has_eol from lineitem"


@query(f"""with i as ({_ITEMS}), l as (select *, lag(str) over w as p, lag(x) over w as px, lag(y) over w as py, lag(width) over w as pw, lag(has_eol) over w as pe from i window w as (partition by page order by seq)),
s as (select page, seq, str, case when p is null then '' when pe then chr(10) when abs(py - y) > greatest(1, abs(font_size)) * 0.6 then chr(10) when x - (px + pw) > greatest(1, abs(font_size)) * 0.2 then ' ' else '' end as sep from l)
select page, string_agg(sep || str, '' order by seq) as text from s group by page""")
def text_item_join(spark, sf):
    """Positioned text items to page texts; line items stand for the items."""
    from palimpsest.sources.pdf import page_texts

    li = _read(spark, sf, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    items = li.select(
        F.col("l_orderkey").alias("page"), seq.alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("str"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("double").alias("x"),
        (F.col("l_tax") * 100).alias("y"), F.lit(12.0).alias("width"), (1 + F.col("l_discount") * 50).alias("font_size"), (F.col("l_linenumber") % 5 == 0).alias("has_eol"),
    )
    return page_texts(items, ["page"])


# ---- batches


@query("""with j as (select o_orderkey, o_custkey, (o_totalprice * 100)::bigint as bytes, o_orderdate from orders), r as (select o_orderkey, o_custkey, sum(bytes) over (partition by o_custkey order by o_orderkey) as total from j),
m as (select o_custkey, min(o_orderkey) filter (total > 67108864) as bad from r group by 1)
select o_orderkey, case when bad is null or o_orderkey < bad then 'succeeded' when o_orderkey = bad then 'failed' else 'not-run' end as status, case when o_orderkey = bad then 'BATCH_OUTPUT_LIMIT' end as error from r join m using (o_custkey)""")
def batch_gate(spark, sf):
    """Orders of a customer as a batch of reports under the cumulative output limit."""
    from palimpsest.plans.batch import output_gate

    jobs = _read(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("long").alias("result_bytes"))
    jobs = jobs.withColumn("status", F.lit("succeeded")).withColumn("error", F.lit(None).cast("struct<code:string,message:string>"))
    return output_gate(jobs).select(F.col("seq").alias("o_orderkey"), "status", F.col("error.code").alias("error"))


@query("""select o_custkey, count(*) filter (o_orderstatus = 'F') as succeeded, count(*) filter (o_orderstatus = 'P') as failed, 0::bigint as cancelled, count(*) filter (o_orderstatus = 'O') as not_run from orders group by o_custkey""")
def batch_status_counts(spark, sf):
    from palimpsest.plans.batch import status_counts

    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("not-run")
    return status_counts(_read(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), status.alias("status"))).withColumnRenamed("batch_id", "o_custkey")


# ---- comparisons


@query(f"""with {LINE_PAIRS}, n as (select doc_id, len(string_split(text, chr(10)))::bigint as n from documents)
select before || '-' || after as pair_id, a.n as before_rows, b.n as after_rows, 0::bigint as out_of_order, 0::bigint as wrong_kind from pairs join n a on a.doc_id = before join n b on b.doc_id = after""")
def alignment_invariants(spark, sf):
    """Every unit stands in one row, rows run in order on both sides, and pairs are of one kind."""
    units = _revision_units(spark, sf)
    rows = al.align(units)
    for side in ("before", "after"):
        own = units.where(F.col("side") == side).select("pair_id", F.col("unit_index").alias(f"{side}_idx"), F.col("kind").alias(f"{side}_kind"))
        rows = rows.join(own, ["pair_id", f"{side}_idx"], "left")
    order = Window.partitionBy("pair_id").orderBy("row_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"lb": F.max("before_idx").over(order), "la": F.max("after_idx").over(order)})
    back = (F.col("before_idx") <= F.col("lb")) | (F.col("after_idx") <= F.col("la"))
    return rows.groupBy("pair_id").agg(
        F.count("before_idx").alias("before_rows"), F.count("after_idx").alias("after_rows"), F.count_if(back).alias("out_of_order"), F.count_if(F.col("before_kind") != F.col("after_kind")).alias("wrong_kind")
    )


@query(f"""with {LINE_PAIRS} select before || '-' || after as pair_id from pairs join documents a on a.doc_id = before join documents b on b.doc_id = after where a.text = b.text""")
def identical_pairs(spark, sf):
    """Pairs whose comparison finds no difference."""
    return cmp.compare_blocks(_revision_units(spark, sf)).results.where("outcome = 'identical'").select("pair_id")


@query()
def compare_documents(spark, sf):
    """Results of all candidate revisions: the flagship query."""
    return cmp.compare_blocks(_revision_units(spark, sf)).results


@query()
def compare_document_rows(spark, sf):
    rows = cmp.compare_blocks(_revision_units(spark, sf)).rows
    return rows.select("pair_id", "row_seq", "row_id", "status", "move_id", "before_idx", "after_idx", "changes", "cell_changes")


@query()
def compare_conversations(spark, sf):
    """Each conversation against the next: turns as units."""
    t = _read(spark, sf, "conversations")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    t = t.select("conv_id", turn.cast("int").alias("unit_index"), "text").where("text is not null")
    none = F.lit(None).cast("int")
    side = lambda name, shift: t.select(F.concat(F.lit("c"), (F.col("conv_id") - shift).cast("string")).alias("pair_id"), F.lit(name).alias("side"), "unit_index", F.lit("paragraph").alias("kind"), none.alias("table_index"), none.alias("row_index"), "text", F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("array<int>").alias("sample"))
    return cmp.compare_blocks(side("before", 0).unionByName(side("after", 1))).results


@query()
def json_reports(spark, sf):
    """Serialized version 2 reports of all pairs, with their sizes."""
    from palimpsest.plans.reports import json_report

    c = cmp.compare_blocks(_revision_units(spark, sf))
    return json_report(c).select("pair_id", "json_bytes", "json", "error")


@query()
def html_reports(spark, sf):
    from palimpsest.plans.reports import html_report

    c = cmp.compare_blocks(_revision_units(spark, sf))
    return html_report(c).select("pair_id", "html_bytes", "html", "error")
