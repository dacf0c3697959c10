"""Every operator put to work on the given tables, each with the same question in SQL."""

from jobtrail.plans import apply, score, tailor, track, watch

_PARTS = (watch, score, tailor, apply, track)

QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES"]
