"""All queries of the library and their SQL."""

from __future__ import annotations

from tessitura.plans import model_queries, more_queries, queries, rule_queries, sound_queries, stream_queries, time_queries

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "model_queries", "more_queries", "rule_queries", "sound_queries", "stream_queries", "time_queries"]
