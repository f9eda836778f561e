"""Every operator as a query over the synthetic tables, each with DuckDB SQL that gives the same rows.

The tables have no weightlifting data, so operators run on analogues: a customer or user stands for an athlete, an
order for a programme, a line item for an entry, a part for an exercise, a document for a chunk, an event for an audit row.
"""

from barloom.queries import analytics, functions, ingestion, planning, programs, records, relations, retrieval, streams  # noqa: F401
from barloom.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401
