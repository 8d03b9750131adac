"""The library's registered queries and their SQL."""

from __future__ import annotations

from timeweave.plans import catalog, edits, folds, intervals, library, pictures, search, series, speech, streams, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (intervals, text, catalog, series, search, folds, edits, streams, library, speech, pictures):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

FLAGSHIP = "f5_moments"
