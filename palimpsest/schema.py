"""Schemas, limits, error codes and options of a document comparison."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

MIB = 1024 * 1024

# Rejection limits.
LIMITS = {
    "document_bytes": 50 * MIB,
    "pair_bytes": 100 * MIB,
    "pages": 200,
    "unit_chars": 100_000,
    "total_chars": 2_000_000,
    "page_pixels": 1200 * 1600,
    "rendered_pixels": 80_000_000,
    "image_chars": 48 * MIB,
    "image_pixels": 12_000_000,
    "report_bytes": 64 * MIB,
    "name_chars": 120,
    "ignored_lines": 100,
    "wall_ms": 120_000,
    "render_width": 1200,
    "render_height": 1600,
    "render_scale": 1.5,
    "zip_entries": 4096,
    "zip_bytes": 100 * MIB,
    "xml_part_bytes": 16 * MIB,
    "xml_total_bytes": 32 * MIB,
    "blocks": 100_000,
    "xml_nodes": 1_000_000,
    "xml_depth": 128,
    "ocr_pages": 20,
    "ocr_page_pixels": 1_920_000,
    "ocr_pixels": 20_000_000,
    "batch_jobs": 20,
    "warnings": 100,
}

UNIT = "pair_id string, side string, unit_index int, kind string, table_index int, row_index int, text string, cells array<string>, sample array<int>"
CHANGE = "struct<kind:string,text:string>"
CELL_CHANGE = f"struct<before_cell:int,after_cell:int,changes:array<{CHANGE}>>"
ALIGNED = "pair_id string, row_seq int, before_idx int, after_idx int"
STATUSES = ("unchanged", "changed", "added", "removed", "moved")


class CompareError(Exception):
    """A rejected input: a stable code and a message."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


@dataclass(frozen=True)
class Options:
    """Query parameters of a comparison; ``check`` raises INVALID_INPUT for values outside their domain."""

    ignore_whitespace: bool = False
    ignore_header_lines: int = 0
    ignore_footer_lines: int = 0
    visual_threshold: int = 24
    detect_moves: bool = True
    ocr_enabled: bool = False
    ocr_before_pages: list[int] = field(default_factory=list)
    ocr_after_pages: list[int] = field(default_factory=list)
    ocr_minimum_confidence: float = 70

    def check(self) -> Options:
        whole = lambda v, most: isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= most
        if not all(isinstance(v, bool) for v in (self.ignore_whitespace, self.detect_moves, self.ocr_enabled)):
            raise CompareError("INVALID_INPUT", "switches must be true or false")
        if not whole(self.ignore_header_lines, LIMITS["ignored_lines"]) or not whole(self.ignore_footer_lines, LIMITS["ignored_lines"]):
            raise CompareError("INVALID_INPUT", "ignored lines must be whole numbers from 0 to 100")
        if not whole(self.visual_threshold, 255):
            raise CompareError("INVALID_INPUT", "the visual threshold must be a whole number from 0 to 255")
        if not 0 <= self.ocr_minimum_confidence <= 100:
            raise CompareError("INVALID_INPUT", "the OCR confidence must be from 0 to 100")
        for pages in (self.ocr_before_pages, self.ocr_after_pages):
            if len(set(pages)) != len(pages) or not all(whole(p, LIMITS["pages"] - 1) for p in pages):
                raise CompareError("INVALID_INPUT", "OCR pages must be unique page indexes")
        if len(self.ocr_before_pages) + len(self.ocr_after_pages) > LIMITS["ocr_pages"]:
            raise CompareError("OCR_PAGE_LIMIT_EXCEEDED", "too many pages selected for OCR")
        return self

    def as_dict(self) -> dict:
        return asdict(self)
