"""All queries with their oracles."""

from workload import checks, dedup, monitoring, profiles, sources, stored

_PARTS = (sources, checks, profiles, dedup, monitoring, stored)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
