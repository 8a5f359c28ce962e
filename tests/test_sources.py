"""Packages, images, PDF, inputs, OCR, streaming."""

import struct
import zlib

import numpy as np
import pytest
from palimpsest.operators import raster
from palimpsest.plans import compare
from palimpsest.schema import UNIT, CompareError, Options
from palimpsest.sources import docx, inputs, ocr, pdf, png
from pyspark.sql import functions as F

BODY = '<w:p><w:r><w:t xml:space="preserve">Hello </w:t><w:tab/><w:t>a &amp; b</w:t><w:br/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/>'


def parts(body=BODY, **more):
    out = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{docx.TYPES}"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{docx.MAIN_TYPE}"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{docx.RELATIONS}"><Relationship Id="r1" Type="{docx.OFFICE_DOCUMENT}" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{docx.WORD}"><w:body>{body}</w:body></w:document>',
    }
    return out | more


def package(files, crc=None, flags=0, size=None):
    data, central = b"", b""
    for name, text in files.items():
        raw = text.encode() if isinstance(text, str) else text
        packer = zlib.compressobj(wbits=-15)
        packed = packer.compress(raw) + packer.flush()
        n = name.encode()
        fields = struct.pack("<HHHHIIIHH", flags, 8, 0, 0, zlib.crc32(raw) if crc is None else crc, len(packed), len(raw) if size is None else size, len(n), 0)
        central += b"PK\1\2" + struct.pack("<HH", 20, 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(data)) + n
        data += b"PK\3\4" + struct.pack("<H", 20) + fields + n + packed
    return data + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(central), len(data), 0)


def test_docx_units():
    units, warnings = docx.read_docx(package(parts()))
    assert warnings == []
    assert [(u["kind"], u["text"], u["cells"], u["table_index"], u["row_index"]) for u in units] == [("paragraph", "Hello \ta & b\n", None, None, None), ("table-row", "1\t\n2", ["1", "\n2"], 0, 0)]


@pytest.mark.parametrize(
    "body,code",
    [("<w:p><w:ins><w:r><w:t>x</w:t></w:r></w:ins></w:p>", "UNREAD_INS"), ("<w:p>stray</w:p>", "STRAY_TEXT"), ("<w:p><w:pPr><w:numPr/></w:pPr></w:p>", "NUMBERING"), ("<w:customXml><w:p><w:r><w:t>x</w:t></w:r></w:p></w:customXml>", "UNREAD_BODY_CONTENT"), ("<w:tbl><w:tr><w:tc><w:tbl/></w:tc></w:tr></w:tbl>", "NESTED_TABLE")],
)
def test_docx_warnings(body, code):
    assert code in docx.read_docx(package(parts(body)))[1]


def test_docx_part_warnings():
    more = {"word/header1.xml": "<x/>", "word/_rels/document.xml.rels": f'<Relationships xmlns="{docx.RELATIONS}"><Relationship Id="a" Type="http://x/hyperlink" Target="http://y" TargetMode="External"/><Relationship Id="b" Type="http://x/comments" Target="comments.xml"/><Relationship Id="c" Type="http://x/other" Target="odd.xml"/></Relationships>'}
    assert set(docx.read_docx(package(parts(**more)))[1]) == {"HEADER", "EXTERNAL_TARGET", "COMMENTS", "RELATED_XML"}


HOSTILE = {
    "traversal": (package(parts(**{"../x": "y"})), "DOCX_PACKAGE_INVALID"),
    "absolute": (package(parts(**{"/x": "y"})), "DOCX_PACKAGE_INVALID"),
    "backslash": (package(parts(**{"a\\x": "y"})), "DOCX_PACKAGE_INVALID"),
    "encoded": (package(parts(**{"%252e%252e/x": "y"})), "DOCX_PACKAGE_INVALID"),
    "case twice": (package(parts(**{"WORD/document.xml": "y"})), "DOCX_PACKAGE_INVALID"),
    "crc": (package(parts(), crc=1), "DOCX_PACKAGE_INVALID"),
    "size": (package(parts(), size=3), "DOCX_PACKAGE_INVALID"),
    "huge": (package(parts(), size=17 * 1024 * 1024), "DOCX_PACKAGE_INVALID"),
    "encrypted": (package(parts(), flags=1), "DOCX_PACKAGE_INVALID"),
    "descriptor": (package(parts(), flags=8), "DOCX_PACKAGE_INVALID"),
    "dtd": (package(parts() | {"word/document.xml": '<!DOCTYPE x><w:document xmlns:w="y"/>'}), "DOCX_XML_INVALID"),
    "entity": (package(parts("<w:p>&nbsp;</w:p>")), "DOCX_XML_INVALID"),
    "deep": (package(parts("<w:p>" * 130 + "</w:p>" * 130)), "DOCX_XML_INVALID"),
    "malformed": (package(parts("<w:p>")), "DOCX_XML_INVALID"),
    "entries": (package(parts(**{f"f{i}": "" for i in range(4100)})), "DOCX_PACKAGE_INVALID"),
    "macro": (package(parts(**{"word/vbaProject.bin": "x"})), "DOCX_UNSUPPORTED_FEATURE"),
    "missing": (package({"a": "b"}), "DOCX_PACKAGE_INVALID"),
    "text": (package(parts("<w:p><w:r><w:t>" + "x" * 100_001 + "</w:t></w:r></w:p>")), "TEXT_LIMIT_EXCEEDED"),
    "no zip": (b"PK nothing", "DOCX_PACKAGE_INVALID"),
    "prefixed": (b"x" + package(parts()), "DOCX_PACKAGE_INVALID"),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_packages(name):
    raw, code = HOSTILE[name]
    with pytest.raises(CompareError) as e:
        docx.read_docx(raw)
    assert e.value.code == code


def test_docx_comparison(spark):
    one = "<w:p><w:r><w:t>total 1250</w:t></w:r></w:p>"
    docs = [("a", package(parts(one + BODY))), ("b", package(parts(one.replace("1250", "1350") + BODY))), ("w", package(parts(BODY, **{"word/footnotes.xml": "<x/>"}))), ("c", package(parts(BODY))), ("bad", b"PK")]
    pairs = [("ab", "a", "b"), ("cw", "c", "w"), ("bad", "a", "bad"), ("none", "a", "zzz")]
    units, warned, errors = docx.docx_pairs(spark.createDataFrame(pairs, "pair_id string, before string, after string"), spark.createDataFrame(docs, "name string, content binary"))
    assert {r.pair_id: r.error for r in errors.collect()} == {"bad": "DOCX_PACKAGE_INVALID", "none": "INVALID_INPUT"}
    res = {r.pair_id: r for r in compare.compare_blocks(units.select(*[f.name for f in spark.createDataFrame([], UNIT).schema]), warnings=warned.where("size(warnings) > 0")).results.collect()}
    assert (res["ab"].changed, res["ab"].unchanged, res["ab"].outcome) == (1, 2, "changed")
    assert (res["cw"].outcome, res["cw"].certainty, res["cw"].warnings) == ("uncertain", "incomplete", ["FOOTNOTES"])


def test_validation(spark):
    rows = [("ok.pdf", "pdf", b"xx%PDF-1.4"), ("d/ok.docx", "docx", b"PK.."), ("e", "pdf", b""), ("m", "pdf", b"PK.."), ("n", "docx", b"%PDF-"), ("f", "txt", b"a"), ("l" * 1025, "pdf", b"%PDF-")]
    df = spark.createDataFrame(rows, "name string, format string, content binary")
    got = {r.name[:9]: r.error and r.error.code for r in inputs.validate(df).collect()}
    assert got == {"ok.pdf": None, "d/ok.docx": None, "e": "INVALID_INPUT", "m": "FORMAT_MISMATCH", "n": "FORMAT_MISMATCH", "f": "INVALID_INPUT", "l" * 9: "INVALID_INPUT"}
    v1 = {r.name[:9]: r.error and r.error.code for r in inputs.validate(df, version=1).collect()}
    assert v1["m"] == "UNSUPPORTED_FORMAT" and v1["f"] == "PDF_DECODE_FAILED" and v1["ok.pdf"] is None
    pairs = spark.createDataFrame([("p", "ok.pdf", "d/ok.docx"), ("q", "ok.pdf", "ok.pdf"), ("r", "ok.pdf", "zz")], "pair_id string, before string, after string")
    assert {r.pair_id: r.error and r.error.code for r in inputs.validate_pairs(pairs, inputs.validate(df)).collect()} == {"p": "FORMAT_MISMATCH", "q": None, "r": "INVALID_INPUT"}


def test_png(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    raw = png.encode_png(image)
    assert (png.decode_png(raw) == image).all()
    for bad in (b"", raw[:40], raw[:50] + b"\0" + raw[51:]):
        with pytest.raises(CompareError):
            png.decode_png(bad)
    import base64

    url = "data:image/png;base64," + base64.b64encode(raw).decode()
    df = spark.createDataFrame([(url,), (url + "!",), ("data:image/gif;base64,AAAA",)], "u string").select(png.png_bytes(F.col("u")).alias("b")).select("b", png.png_size(F.col("b")).alias("s"))
    got = df.collect()
    assert bytes(got[0].b) == raw and (got[0].s.width, got[0].s.height) == (7, 5)
    assert got[1].b is None and got[2].b is None


def test_page_images(spark):
    white = np.full((4, 4, 4), 255, np.uint8)
    dark = white.copy()
    dark[0, 0, :3] = 0
    images = [("p", "before", 0, png.encode_png(white)), ("p", "after", 0, png.encode_png(dark))]
    rows = spark.createDataFrame([("p", 1, 0, 0, "moved"), ("p", 2, 1, None, "removed")], "pair_id string, row_seq int, before_idx int, after_idx int, status string")
    out = {r.row_seq: r.visual for r in raster.page_differences(rows, spark.createDataFrame(images, "pair_id string, side string, unit_index int, png binary"), 24, "moved").collect()}
    assert out[1].changed_pixels == 1 and out[1].total_pixels == 16 and out[1].ratio == 1 / 16 and out[2] is None


def simple_pdf(pages):
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    for i, content in enumerate(pages):
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1)) + "trailer << /Root 1 0 R >>\n%%EOF\n").encode()


def test_pdf(spark):
    docs = [("a", simple_pdf(["BT /F1 12 Tf 10 700 Td (Total \\(net\\)) Tj 0 -20 Td (second line) Tj ET", ""])), ("bad", b"%PDF-1.4 cut")]
    units, errors = pdf.pdf_units(spark.createDataFrame(docs, "name string, content binary"))
    assert [(r.unit_index, r.text) for r in units.orderBy("unit_index").collect()] == [(0, "Total (net)\nsecond line"), (1, "")]
    assert [(r.name, r.error) for r in errors.collect()] == [("bad", "PDF_DECODE_FAILED")]


def png_page(*shape, dark=0):
    image = np.full((*shape, 4), 255, np.uint8)
    image[: dark or 0, :, :3] = 0
    return png.encode_png(image)


IMAGES = "pair_id string, side string, unit_index int, png binary"


def test_ocr(spark):
    page = lambda side, i, t: ("p", side, i, "page", None, None, t, None, [10] * 4)
    rows = compare.compare_pages(spark.createDataFrame([page("before", 0, ""), page("after", 0, ""), page("before", 1, "text here"), page("after", 1, "text here")], UNIT)).rows
    small, wide = png_page(2, 2), png_page(2, 3)
    images = spark.createDataFrame([("p", "before", 0, small), ("p", "after", 0, wide)], IMAGES)
    options = Options(ocr_enabled=True, ocr_before_pages=[0, 1], ocr_after_pages=[0])
    out, told, failed = ocr.enrich(rows, images, options, lambda raw: ("1250" if raw == small else "1350\r\n", 95.0 if raw == small else 20.0))
    got = {r.row_seq: r for r in out.collect()}
    assert (got[1].before_text, got[1].after_text, got[1].status, got[1].before_evidence, got[1].after_confidence) == ("1250", "1350\n", "changed", "ocr", 20.0)
    assert got[2].status == "unchanged" and failed.count() == 0
    assert told.first().warnings == ["OCR_HEURISTIC", "OCR_LOW_CONFIDENCE after 1", "OCR_SKIPPED before 2"]

    def error(engine, images=images, **more):
        found = ocr.enrich(rows, images, Options(ocr_enabled=True, **({"ocr_before_pages": [0]} | more)), engine)[2].collect()
        return [r.error for r in found]

    assert error(None) == ["OCR_UNAVAILABLE"]
    assert error(lambda raw: 1 / 0) == ["OCR_FAILED"]
    assert error(lambda raw: ("x" * 100_001, 90)) == ["TEXT_LIMIT_EXCEEDED"]
    assert error(lambda raw: ("x", 90), ocr_before_pages=[5]) == ["INVALID_INPUT"]
    assert error(lambda raw: ("x", 90), images.where("side = 'after'")) == ["OCR_FAILED"]


def test_pdf_plan(spark):
    """OCR text takes part in a move, the moved page's pixels are compared, a pair past a limit is an error."""
    page = lambda pair, side, i, t: (pair, side, i, "page", None, None, t, None, None)
    units = [page("p", "before", 0, ""), page("p", "before", 1, "alpha one two"), page("p", "before", 2, "gamma three four")]
    units += [page("p", "after", 0, "alpha one two"), page("p", "after", 1, "gamma three four"), page("p", "after", 2, "read by the engine")]
    units += [page("big", s, i, "x" * 99_000) for s in ("before", "after") for i in range(11)]
    shots = {("before", 0): png_page(4, 4), ("before", 1): png_page(4, 4, dark=1), ("before", 2): png_page(4, 4, dark=2), ("after", 0): png_page(4, 4, dark=1), ("after", 1): png_page(4, 4, dark=2), ("after", 2): png_page(4, 4, dark=3)}
    images = [("p", s, i, raw) for (s, i), raw in shots.items()] + [("big", s, i, png_page(1, 1)) for s in ("before", "after") for i in range(11)]
    options = Options(ocr_enabled=True, ocr_before_pages=[0])
    c = compare.compare_pdf(spark.createDataFrame(units, UNIT), spark.createDataFrame(images, IMAGES), options, lambda raw: ("read by the engine", 95))
    rows = [r for r in c.rows.orderBy("row_seq").collect()]
    moved = [r for r in rows if r.status == "moved"]
    assert [(r.before_idx, r.after_idx) for r in moved] == [(0, 2)] and moved[0].row_id == moved[0].move_id
    assert moved[0].changed_pixels == 12 and moved[0].before_evidence == "ocr"
    assert [(r.before_idx, r.after_idx, r.status, r.changed_pixels) for r in rows if r.status != "moved"] == [(1, 0, "unchanged", 0), (2, 1, "unchanged", 0)]
    assert {r.pair_id: r.error for r in c.errors.collect()} == {"big": "TEXT_LIMIT_EXCEEDED"}
    (r,) = c.results.collect()
    assert (r.moved, r.outcome, r.certainty, r.warnings) == (1, "changed", "incomplete", ["OCR_HEURISTIC"])
    with pytest.raises(CompareError):
        compare.compare_pdf(spark.createDataFrame(units, UNIT), spark.createDataFrame(images, IMAGES), Options(ocr_enabled=True))
    with pytest.raises(CompareError):
        compare.compare_blocks(spark.createDataFrame(units, UNIT), options)


def test_find_bytes(spark):
    rows = [(bytes.fromhex("02550444 62D0") + b"%PDF-", 6), (b"xPDF-", -1), (b"\xff" * 1020 + b"%PDF-", -1), (b"%PDF-", 0)]
    df = spark.createDataFrame(rows, "content binary, at int")
    assert [r.at == r.found for r in df.withColumn("found", inputs.find_bytes(F.col("content"), b"%PDF-", 1024)).collect()] == [True] * 4


def test_text_of_both_sides(spark):
    body = "".join(f"<w:p><w:r><w:t>{'x' * 99_000}</w:t></w:r></w:p>" for _ in range(11))
    docs = [("a", package(parts(body)))]
    _, _, errors = docx.docx_pairs(spark.createDataFrame([("aa", "a", "a")], "pair_id string, before string, after string"), spark.createDataFrame(docs, "name string, content binary"))
    assert [r.error for r in errors.collect()] == ["TEXT_LIMIT_EXCEEDED"]


def test_stream(spark, tmp_path):
    from palimpsest.streaming.ingest import scan_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(package(parts()))
    (tmp_path / "in/b.docx").write_bytes(b"nope")
    scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.name[-6:]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got["a.docx"].units) == 2 and got["b.docx"].error == "FORMAT_MISMATCH"
