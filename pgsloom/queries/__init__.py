"""All queries of the engine and the SQL of those that SQL can express."""

from pgsloom.queries import catalog, dna, etl, norms, report, scoring, sources, streams  # noqa: F401
from pgsloom.queries.base import QUERIES, SQL  # noqa: F401
