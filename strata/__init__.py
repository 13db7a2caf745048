"""A PySpark-native analytics engine with a fluent, order-aware query API."""

from strata.errors import EngineError, ExecutionError, InvalidQueryError, InvalidStateError, IteratorExhaustedError, TypeMismatchError
from strata.operators.metered import MeteredQuery, Metrics
from strata.operators.query import Query
from strata.sources.adapters import as_query, from_parquet

__all__ = [
    "EngineError", "ExecutionError", "InvalidQueryError", "InvalidStateError", "IteratorExhaustedError", "MeteredQuery", "Metrics", "Query", "TypeMismatchError", "as_query", "from_parquet",
]
