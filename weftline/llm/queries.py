"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("residue", "repeated", "seen", "body", "encoding", "packing", "subjects"):
    try:
        _m = importlib.import_module(f"weftline.llm.{_name}_queries")
    except ModuleNotFoundError as e:
        if e.name != f"weftline.llm.{_name}_queries":
            raise
        continue
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
