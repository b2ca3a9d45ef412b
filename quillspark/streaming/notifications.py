"""What happens to assets, as it happens."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime


@dataclass(frozen=True)
class Event:
    """kind: status, log, progress, error, expired, removed."""

    kind: str
    asset: str
    message: str = ""
    done: int = 0
    total: int = 0
    time: datetime = field(default_factory=lambda: datetime.now(UTC))


class Hub:
    def __init__(self):
        self._subscribers: dict[int, tuple[str | None, Callable[[Event], None]]] = {}
        self._lock, self._next = threading.Lock(), 0

    def subscribe(self, f: Callable[[Event], None], asset: str | None = None) -> Callable[[], None]:
        """f gets the events of one asset, or of all; the result ends that."""
        with self._lock:
            number = self._next = self._next + 1
            self._subscribers[number] = asset, f
        return lambda: self._subscribers.pop(number, None) and None

    def send(self, event: Event) -> None:
        for asset, f in [*self._subscribers.values()]:
            if asset in (None, event.asset):
                f(event)


def job_progress(spark, group: str) -> tuple[int, int]:
    """Tasks that a job group has done, and all that it has so far."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (i := tracker.getJobInfo(j)) for s in i.stageIds]
    return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)
