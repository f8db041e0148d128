"""All queries of the library over the given tables, with the SQL that must give the same rows."""

from . import graph_plans, model_plans, snapshot_plans, stat_plans, stream_plans, table_plans, time_plans  # noqa: F401  (they register their queries)
from .bind import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
