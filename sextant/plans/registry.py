"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from sextant.plans import core, dated, evaluation, families, filings, live, portfolio, research, storage, streams

QUERIES: dict = {}
ORACLES: dict = {}
for part in (core, evaluation, dated, filings, research, families, portfolio, storage, live, streams):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
