"""Page texts from positioned text items, and a reader for simple text PDFs.

The reader knows cross-reference tables, Flate streams and the text operators of content streams with
one-byte encodings.  Encrypted files, object streams, other filters and rendering are out of its
reach: it rejects those (PDF_DECODE_FAILED), and pages come as tables of items and images instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import SPACE, extracted_text, utf16_length
from palimpsest.schema import LIMITS, CompareError

ITEM = "seq int, str string, x double, y double, width double, font_size double, has_eol boolean"


def separators(items: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``sep``, what stands before each item: a line end, a blank or nothing, from the place of the last one."""
    order = Window.partitionBy(*keys).orderBy("seq")
    last = lambda c: F.lag(c).over(order)
    size = F.greatest(F.lit(1.0), F.abs(F.col("font_size")))
    spaced = last("str").rlike(f"(?s){SPACE}$") | F.col("str").rlike(f"^{SPACE}")
    placed = last("x").isNotNull() & F.col("x").isNotNull() & last("y").isNotNull() & F.col("y").isNotNull() & last("width").isNotNull()
    sep: Column = (
        F.when(last("str").isNull(), "")
        .when(last("has_eol"), "\n")
        .when(spaced | ~placed, "")
        .when(F.abs(last("y") - F.col("y")) > size * 0.6, "\n")
        .when(F.col("x") - (last("x") + last("width")) > size * 0.2, " ")
        .otherwise("")
    )
    return items.withColumn("sep", sep)


def page_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the items of each page in order."""
    parts = separators(items, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", F.concat("sep", "str").alias("t")))).alias("p"))
    return parts.select(*keys, extracted_text(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("text"))


def text_limit(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, error: documents whose pages, or all of them together, hold too much text, or that have too many pages."""
    chars = utf16_length(F.col("text"))
    per = pages.groupBy(*keys).agg(F.max(chars).alias("most"), F.sum(chars).alias("total"), F.count(F.lit(1)).alias("n"))
    long = (F.col("most") > LIMITS["unit_chars"]) | (F.col("total") > LIMITS["total_chars"])
    return per.select(*keys, F.when(F.col("n") > LIMITS["pages"], "TOO_MANY_PAGES").when(long, "TEXT_LIMIT_EXCEEDED").alias("error"))


def _fail(why: str) -> CompareError:
    return CompareError("PDF_DECODE_FAILED", why)


class PdfReader:
    """Objects of a file by number, read when asked for."""

    def __init__(self, raw: bytes):
        if b"%PDF-" not in raw[:1024]:
            raise _fail("no PDF header")
        if b"/Encrypt" in raw or b"/ObjStm" in raw:
            raise _fail("encrypted or compressed objects")
        self.raw = raw
        self.places = {int(m[1]): m.end() for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", raw)}
        if not self.places or not raw.rstrip().endswith(b"%%EOF"):
            raise _fail("truncated file")

    def body(self, number: int) -> bytes:
        if number not in self.places:
            raise _fail("missing object")
        at = self.places[number]
        end = self.raw.find(b"endobj", at)
        if end < 0:
            raise _fail("open object")
        return self.raw[at:end]

    def stream(self, number: int) -> bytes:
        body = self.body(number)
        head, mark, rest = body.partition(b"stream")
        if not mark:
            raise _fail("no stream")
        data = rest[2:] if rest[:2] == b"\r\n" else rest[1:]
        data = data[: data.rfind(b"endstream")].rstrip(b"\r\n") if b"endstream" in data else data
        if b"/FlateDecode" in head:
            try:
                return zlib.decompressobj().decompress(data, LIMITS["xml_part_bytes"])
            except zlib.error:
                raise _fail("damaged stream") from None
        if b"/Filter" in head:
            raise _fail("unknown filter")
        return data

    def pages(self) -> list[bytes]:
        """Dictionaries of the pages, in order."""
        root = next((self.body(n) for n in self.places if re.search(rb"/Type\s*/Catalog\b", self.body(n))), None)
        top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root or b"")
        if not top:
            raise _fail("no page tree")
        out, todo, seen = [], [int(top[1])], set()
        while todo:
            number = todo.pop()
            if number in seen:
                raise _fail("page tree in a loop")
            seen.add(number)
            body = self.body(number)
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
            if kids:
                todo += [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
            else:
                out.append(body)
            if len(out) > LIMITS["pages"]:
                raise CompareError("TOO_MANY_PAGES", "over 200 pages")
        return out

    def contents(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", page)
        if not m:
            return b""
        numbers = [int(m[2])] if m[2] else [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]
        return b"\n".join(self.stream(n) for n in numbers)


_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        return bytes.fromhex(token[1:-1].decode()).decode("latin-1")
    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("latin-1")


def text_items(content: bytes) -> Iterator[tuple[str, float, float, float, float]]:
    """(str, x, y, width, font size) of a content stream; a width is half the size per character."""
    x = y = line_x = line_y = 0.0
    size, lead, scale, stack = 1.0, 0.0, 1.0, []
    strings: list = []
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<":
            strings.append(_string(t))
        elif re.fullmatch(rb"[+-]?\d*\.?\d+", t):
            stack.append(float(t))
            strings.append(float(t))
        elif t in (b"[", b"]") or t[:1] == b"/":
            continue
        else:
            if t == b"BT":
                x = y = line_x = line_y = 0.0
                scale = 1.0
            elif t == b"Tf" and stack:
                size = stack[-1]
            elif t == b"TL" and stack:
                lead = stack[-1]
            elif t in (b"Td", b"TD") and len(stack) >= 2:
                line_x, line_y = line_x + stack[-2] * scale, line_y + stack[-1] * scale
                x, y = line_x, line_y
                if t == b"TD":
                    lead = -stack[-1]
            elif t == b"Tm" and len(stack) >= 6:
                scale = stack[-6] or 1.0
                line_x, line_y = stack[-2], stack[-1]
                x, y = line_x, line_y
            elif t in (b"T*", b"'", b'"'):
                line_y -= lead * scale
                x, y = line_x, line_y
            if t in (b"Tj", b"'", b'"', b"TJ"):
                shown = "".join(s for s in strings if isinstance(s, str))
                width = 0.5 * size * scale * len(shown)
                if shown:
                    yield shown, x, y, width, size * scale
                x += width
            stack, strings = [], []


PAGES = f"struct<pages:array<struct<items:array<struct<{', '.join(x.replace(' ', ':') for x in ITEM.split(', '))}>>>>,error:string>"


def _read_pages(raw: bytes) -> list[dict]:
    reader = PdfReader(raw)
    names = ("seq", "str", "x", "y", "width", "font_size", "has_eol")
    return [{"items": [dict(zip(names, (i, *item, False), strict=True)) for i, item in enumerate(text_items(reader.contents(page)))]} for page in reader.pages()]


def pdf_pages(content: Column) -> Column:
    """Pages of PDF bytes as items, or an error code."""

    @F.pandas_udf(PAGES)
    def pages(contents: pd.Series) -> pd.DataFrame:
        out = []
        for raw in contents:
            try:
                out.append((_read_pages(bytes(raw or b"")), None))
            except CompareError as e:
                out.append((None, e.code))
        return pd.DataFrame(out, columns=["pages", "error"])

    return pages(content)


def pdf_units(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs(name, content)`` to (units: name, unit_index, text; errors: name, error)."""
    read = docs.select("name", pdf_pages(F.col("content")).alias("r"))
    pages = read.select("name", F.posexplode("r.pages").alias("unit_index", "page"))
    items = pages.select("name", "unit_index", F.inline("page.items"))
    texts = pages.select("name", "unit_index").join(page_texts(items, ["name", "unit_index"]), ["name", "unit_index"], "left")
    units = texts.withColumn("text", F.coalesce("text", F.lit("")))
    errors = read.select("name", F.col("r.error").alias("error")).where("error is not null")
    over = text_limit(units, ["name"]).where("error is not null")
    return units, errors.union(over)
