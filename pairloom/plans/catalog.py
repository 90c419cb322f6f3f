"""All queries of the library and their SQL."""

from __future__ import annotations

from pairloom.plans import contact_queries, interval_queries, more_queries, score_queries

QUERIES, ORACLES = {}, {}
for part in (contact_queries, interval_queries, score_queries, more_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
