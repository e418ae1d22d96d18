"""Named queries of the training-data operators, gathered from the query modules of this package."""

from __future__ import annotations

import importlib

_PARTS = ("form_queries", "overlap_queries", "residue_queries", "abuse_queries", "language_queries", "personal_queries", "packing_queries")
QUERIES: dict = {}
ORACLE: dict = {}
for _part in _PARTS:
    _module = importlib.import_module(f"murmuro.llm.{_part}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
