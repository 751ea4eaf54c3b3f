"""Named queries over the driver's tables, with the SQL that each equals."""

from vitrine.plans import aggregates, assembly, catalog, changes, joins, lookups, manifests, ranking, scalars, scans, sources, streams  # noqa: F401
from vitrine.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
