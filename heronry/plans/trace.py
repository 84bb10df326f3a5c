"""Traces of searches, and small caches of the driver."""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession


class Tracer:
    """Spans of one search. Spark is lazy: the engine computes what a span is named for within it."""

    def __init__(self, query: str):
        self.id, self.query, self.started_at, self.spans = str(uuid.uuid4()), query, datetime.now(timezone.utc), []
        self._begun = time.perf_counter()

    def _now(self) -> float:
        return (time.perf_counter() - self._begun) * 1000

    @contextmanager
    def span(self, name: str, **attributes: Any) -> Iterator[dict[str, Any]]:
        began = self._now()
        try:
            yield attributes
        except Exception as e:
            attributes["error"] = str(e)
            raise
        finally:
            self.record(name, began, self._now(), **attributes)

    def record(self, name: str, start_ms: float, end_ms: float, **attributes: Any) -> None:
        self.spans.append({"name": name, "start_ms": start_ms, "end_ms": end_ms, "duration_ms": end_ms - start_ms, "attributes": attributes})

    def finish(self, **facts: Any) -> dict[str, Any]:
        return {"id": self.id, "query": self.query, "started_at": self.started_at, "total_ms": self._now(), "spans": self.spans} | facts


def _positive(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("capacity must be a positive whole number")
    return n


class TraceStore:
    """The last traces, newest first."""

    def __init__(self, capacity: int = 1000):
        self._held: deque = deque(maxlen=_positive(capacity))

    def push(self, trace: dict[str, Any]) -> None:
        self._held.append(trace)

    def save(self, spark: SparkSession, folder: str) -> int:
        """Appends the held traces, oldest first, to a table of JSON rows (id, started_at, trace); how many there were."""
        rows = [(t["id"], t.get("started_at"), json.dumps(t, default=str)) for t in self._held]
        if rows:
            spark.createDataFrame(rows, "id string, started_at timestamp, trace string").coalesce(1).write.mode("append").parquet(folder)
        return len(rows)

    def list(self, limit: int = 100) -> list[dict[str, Any]]:
        return [*reversed(self._held)][:limit]

    def get(self, id_: str) -> dict[str, Any] | None:
        return next((t for t in self._held if t["id"] == id_), None)

    def clear(self) -> None:
        self._held.clear()

    @property
    def size(self) -> int:
        return len(self._held)


class BoundedCache:
    """A map of limited size that forgets what was used longest ago; `forget` is called with what goes."""

    def __init__(self, capacity: int, forget: Callable[[Any], None] | None = None):
        self.capacity, self._held, self._forget = _positive(capacity), OrderedDict(), forget

    def get(self, key: Hashable, default: Any = None) -> Any:
        if key not in self._held:
            return default
        self._held.move_to_end(key)
        return self._held[key]

    def set(self, key: Hashable, value: Any) -> None:
        self._held[key] = value
        self._held.move_to_end(key)
        while len(self._held) > self.capacity:
            _, gone = self._held.popitem(last=False)
            if self._forget:
                self._forget(gone)

    def __contains__(self, key: Hashable) -> bool:
        return key in self._held

    def __len__(self) -> int:
        return len(self._held)

    def clear(self) -> None:
        self._held.clear()
