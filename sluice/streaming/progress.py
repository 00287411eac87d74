"""Progress and supervision of running queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql.streaming import StreamingQuery


@dataclass
class CompletedFrontier:
    """The largest completed time; it never goes back."""

    time: int = 0

    def advance(self, to: int) -> int:
        self.time = max(self.time, to)
        return self.time


def watermark_ms(query: StreamingQuery) -> int:
    """The query's watermark, 0 before it has one."""
    found = ((query.lastProgress or {}).get("eventTime") or {}).get("watermark")
    return int(datetime.fromisoformat(found.replace("Z", "+00:00")).timestamp() * 1000) if found else 0


@dataclass
class Progress:
    """The least frontier of several sinks."""

    queries: list[StreamingQuery]
    frontiers: dict[str, CompletedFrontier] = field(default_factory=dict)

    def frontier(self) -> int:
        return min((self.frontiers.setdefault(str(q.id), CompletedFrontier()).advance(watermark_ms(q)) for q in self.queries), default=0)

    def less_than(self, t: int) -> bool:
        return self.frontier() < t

    def less_equal(self, t: int) -> bool:
        return self.frontier() <= t


class EscalatedError(RuntimeError):
    """A failure that the policy hands on."""


def supervise(start: Callable[[], StreamingQuery], policy: str = "restart", max_restarts: int = 3, backoff_s: float = 0.0) -> int:
    """Runs a query to its end; `restart` starts it again from its checkpoint, `stop` gives up quietly, `escalate` raises. Returns the restarts."""
    if policy not in ("restart", "stop", "escalate"):
        raise ValueError(f"policy: {policy}")
    restarts = 0
    while True:
        try:
            start().awaitTermination()
            return restarts
        except Exception as e:
            if policy == "stop":
                return restarts
            if policy == "escalate" or restarts >= max_restarts:
                raise EscalatedError(str(e)) from e
            restarts += 1
            time.sleep(backoff_s)


def supervise_group(starts: list[Callable[[], StreamingQuery]], max_restarts: int = 3, backoff_s: float = 0.0) -> int:
    """Runs queries that belong together to their ends: when one fails, all are stopped and started again from their checkpoints. Returns the restarts."""
    restarts = 0
    while True:
        running = [start() for start in starts]
        try:
            while any(q.isActive for q in running):
                if any(not q.isActive and q.exception() is not None for q in running):
                    break
                time.sleep(0.05)
            failed = next((q.exception() for q in running if q.exception() is not None), None)
        finally:
            for q in running:
                q.stop()
        if failed is None:
            return restarts
        if restarts >= max_restarts:
            raise EscalatedError(str(failed))
        restarts += 1
        time.sleep(backoff_s)


class Lifecycle:
    """Queries that are started, paused, resumed and stopped together. Paused ones keep their place in their checkpoints; stopped ones don't go on."""

    def __init__(self, starts: list[Callable[[], StreamingQuery]]):
        self.starts, self.queries, self.state = starts, [], "new"

    def start(self) -> None:
        if self.state not in ("new", "paused"):
            raise ValueError(f"can't start when {self.state}")
        self.queries, self.state = [f() for f in self.starts], "running"

    resume = start

    def pause(self) -> None:
        if self.state != "running":
            raise ValueError(f"can't pause when {self.state}")
        for q in self.queries:
            q.stop()
        self.state = "paused"

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries, self.state = [], "stopped"


@dataclass
class Scaler:
    """scale() in ticks: a bound must hold for `stable_s`, and `cooldown_s` must pass between changes."""

    shards: int
    stable_s: float = 30.0
    cooldown_s: float = 60.0
    bounds: dict = field(default_factory=dict)
    _since: tuple[int, float] | None = None
    _changed: float = float("-inf")

    def tick(self, now: float, rate: float, backlog: int) -> int:
        to = scale(self.shards, rate, backlog, **self.bounds)
        way = (to > self.shards) - (to < self.shards)
        if way == 0 or self._since is None or self._since[0] != way:
            self._since = (way, now) if way else None
        if way and now - self._since[1] >= self.stable_s and now - self._changed >= self.cooldown_s:
            self.shards, self._changed, self._since = to, now, None
        return self.shards


def scale(shards: int, rate: float, backlog: int, least: int = 1, most: int = 1000, up_rate: float = 10_000, up_backlog: int = 50_000, down_rate: float = 1_000) -> int:
    """Shards (executors) for a load: one more above either bound, one less below down_rate without a backlog. On a cluster dynamic allocation does this."""
    if rate > up_rate or backlog > up_backlog:
        return min(most, shards + 1)
    return max(least, shards - 1) if rate < down_rate and not backlog else shards
