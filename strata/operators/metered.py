"""Metered execution: each terminal is counted and timed under the operation's name."""

from __future__ import annotations

import threading
import time

from strata.operators.query import Query

TERMINALS = ("sum", "average", "min", "max", "min_by", "max_by", "group_by", "group_by_aggregate", "partition", "count", "first", "last", "any", "all")


class Metrics:
    """Named counters and durations, safe to share between threads."""

    def __init__(self):
        self._lock, self._counts, self._seconds = threading.Lock(), {}, {}

    def increment(self, name: str) -> None:
        with self._lock:
            self._counts[name] = self._counts.get(name, 0) + 1

    def get(self, name: str) -> int | None:
        with self._lock:
            return self._counts.get(name)

    def record_query_execution(self, operation: str, seconds: float) -> None:
        name = f"query_{operation}"
        self.increment(name)
        with self._lock:
            n, least, most = self._seconds.get(name, (0.0, seconds, seconds))
            self._seconds[name] = (n + seconds, min(least, seconds), max(most, seconds))

    def durations(self, name: str) -> dict[str, float] | None:
        """Total, least and greatest seconds."""
        with self._lock:
            return dict(zip(("total", "min", "max"), self._seconds[name], strict=True)) if name in self._seconds else None


class MeteredQuery:
    """A query whose terminals are recorded: ``query_{name}`` for collect, ``query_{name}_{terminal}`` for the rest."""

    def __init__(self, query: Query, metrics: Metrics, name: str):
        self._query, self._metrics, self._name = query, metrics, name

    def __getattr__(self, attribute: str):
        found = getattr(self._query, attribute)
        if not callable(found):
            return found

        def call(*args, **options):
            args = [a._query if isinstance(a, MeteredQuery) else a for a in args]
            if attribute != "collect" and attribute not in TERMINALS:
                out = found(*args, **options)
                return MeteredQuery(out, self._metrics, self._name) if isinstance(out, Query) else out
            began = time.perf_counter()
            out = found(*args, **options)
            suffix = "" if attribute == "collect" else f"_{attribute}"
            self._metrics.record_query_execution(self._name + suffix, time.perf_counter() - began)
            return out

        return call
