"""Every operator as a query over the given tables, next to the SQL that must give the same."""

from martspark.plans import chat_queries, incremental_queries, mart_queries, quality_queries, table_queries, text_queries, vector_queries
from martspark.plans.registry import ORACLES, QUERIES

# Importing the modules above fills the register.
MODULES = (mart_queries, quality_queries, chat_queries, text_queries, table_queries, vector_queries, incremental_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
