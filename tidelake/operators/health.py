"""Metrics and health: roll-ups as aggregations, and the driver's small state machines."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = ("healthy", "degraded", "unhealthy")


def histogram(rows: DataFrame, column: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts: ``le`` and how many values are at most that; infinity last.  One pass."""
    all_bounds = (*bounds, math.inf)
    one = rows.agg(*(F.count_if(F.col(column) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(all_bounds)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(all_bounds)))))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def rollup(rows: DataFrame) -> DataFrame:
    """rows: ``component``, ``status``.  One row: the worst status, and how many components have it."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    each = rows.groupBy("component").agg(F.max(rank).alias("s"))
    worst = F.when(F.max("s") == 2, "unhealthy").when(F.max("s") == 1, "degraded").otherwise("healthy")
    return each.agg(worst.alias("status"), F.count("*").alias("components"), F.count_if(F.col("s") == 2).alias("unhealthy"), F.count_if(F.col("s") == 1).alias("degraded"))


@dataclass
class Health:
    """Components' states and what keeps the engine from being ready."""

    components: dict[str, tuple[str, str]] = field(default_factory=dict)
    blockers: dict[str, str] = field(default_factory=dict)

    def mark(self, component: str, status: str, detail: str = "") -> None:
        if status not in SEVERITY:
            raise ValueError(status)
        self.components[component] = (status, detail)

    def block(self, name: str, reason: str) -> None:
        self.blockers[name] = reason

    def unblock(self, name: str) -> None:
        self.blockers.pop(name, None)

    def status(self) -> str:
        return max((s for s, _ in self.components.values()), key=SEVERITY.index, default="healthy")

    def ready(self) -> bool:
        return self.status() != "unhealthy" and not self.blockers


class CircuitBreaker:
    """Opens after so many failures, tries again after a while, closes after so many successes."""

    def __init__(self, failures: int = 5, open_s: float = 30.0, successes: int = 2, clock: Callable[[], float] = time.monotonic):
        self.limit, self.open_s, self.needed, self.clock = failures, open_s, successes, clock
        self.reset()

    def reset(self) -> None:
        self._state, self._bad, self._good, self._since = "closed", 0, 0, 0.0

    @property
    def state(self) -> str:
        if self._state == "open" and self.clock() - self._since >= self.open_s:
            self._state, self._good = "half_open", 0
        return self._state

    def allow(self) -> bool:
        return self.state != "open"

    def success(self) -> None:
        if self.state == "half_open":
            self._good += 1
            if self._good >= self.needed:
                self.reset()
        elif self._state == "closed":
            self._bad = 0

    def failure(self) -> None:
        self._bad += 1
        if self.state == "half_open" or self._bad >= self.limit:
            self._state, self._since = "open", self.clock()

    def run(self, f: Callable):
        if not self.allow():
            raise RuntimeError("the circuit is open")
        try:
            out = f()
        except Exception:
            self.failure()
            raise
        self.success()
        return out


class TtlCache:
    """Values that last for a time by kind, with counts of hits and misses."""

    #: Seconds, by kind.
    TTL = {"snapshot": 1, "schema": 300, "spec": 300, "manifest": 60, "location": 600}

    def __init__(self, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.most, self.clock, self.hits, self.misses = most, clock, 0, 0
        self._values: dict[tuple[str, str], tuple[float, object]] = {}
        self._lock = threading.Lock()

    def get(self, kind: str, key: str, make: Callable[[], object]):
        with self._lock:
            found = self._values.get((kind, key))
            if found and self.clock() < found[0]:
                self.hits += 1
                return found[1]
            self.misses += 1
        value = make()
        with self._lock:
            if len(self._values) >= self.most:
                self._values.pop(next(iter(self._values)))
            self._values[kind, key] = (self.clock() + self.TTL[kind], value)
        return value

    def invalidate(self, kind: str | None = None) -> None:
        with self._lock:
            self._values = {k: v for k, v in self._values.items() if kind is not None and k[0] != kind}

    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


def prometheus(values: dict[str, float], prefix: str = "", kinds: dict[str, str] | None = None) -> str:
    """Metrics in the text format that scrapers read."""
    out = []
    for name, v in sorted(values.items()):
        full, kind = f"{prefix}{name}", (kinds or {}).get(name, "counter" if name.endswith("_total") else "gauge")
        out += [f"# TYPE {full} {kind}", f"{full} {v:g}"]
    return "\n".join(out) + "\n"


def prometheus_histogram(name: str, rows: list, total: float, prefix: str = "") -> str:
    """A histogram from the rows of ``histogram``."""
    full = f"{prefix}{name}"
    out = [f"# TYPE {full} histogram"] + [f'{full}_bucket{{le="{"+Inf" if math.isinf(r.le) else f"{r.le:g}"}"}} {r.n}' for r in sorted(rows, key=lambda r: r.le)]
    return "\n".join([*out, f"{full}_sum {total:g}", f"{full}_count {max(r.n for r in rows)}"]) + "\n"
