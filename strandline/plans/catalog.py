"""All registered queries and the SQL that must give the same rows."""

from strandline.plans import calendar_queries, document_queries, file_queries, function_queries, interval_queries, merge_queries, number_queries, ordered_queries, scalar_queries, stream_queries, table_queries, value_queries  # noqa: F401
from strandline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
