"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query name -> (module, function, name of the module's SQL or None)
_QUERIES = {
    "op2_suffix_dedup": ("repeats", "op2_suffix_dedup", None),
    "op4_katz": ("katz", "op4_katz", None),
    "op7_line_dedup": ("line_dedup", "op7_line_dedup", None),
    "op9_near_dedup": ("near_dedup", "op9_near_dedup", "ORACLE"),
    "op5_decontamination": ("decontamination", "op5_decontamination", "ORACLE"),
    "op6_warc": ("warc", "op6_warc", "ORACLE"),
    "op1_token_store": ("token_store", "op1_token_store", None),
    "op3_packing": ("packing", "op3_packing", None),
    "op8_quality_rules": ("quality_rules", "op8_quality_rules", "ORACLE"),
    "op10_url_rules": ("url_rules", "op10_url_rules", "ORACLE"),
}


def _load(module: str):
    return importlib.import_module(f"palimpsest.llm.{module}")


def queries() -> dict:
    return {name: getattr(_load(m), f) for name, (m, f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_load(m), sql) for name, (m, _, sql) in _QUERIES.items() if sql}
