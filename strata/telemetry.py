"""Events of reads, writes and the ledger, without any literal of a filter."""

from __future__ import annotations

import hashlib
import threading
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from strata.functions.predicate import Predicate, shape


@dataclass(frozen=True)
class Event:
    group: str  # read, write, ledger
    kind: str
    measurements: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


class Telemetry:
    def __init__(self, keep: int = 10_000):
        self.listeners: list[Callable[[Event], None]] = []
        self.events: list[Event] = []
        self.counts: Counter[tuple[str, str]] = Counter()
        self.keep, self.lock = keep, threading.Lock()

    def emit(self, group: str, kind: str, measurements: dict | None = None, **metadata) -> None:
        event = Event(group, kind, measurements or {}, metadata)
        with self.lock:
            self.counts[group, kind] += 1
            self.events.append(event)
            del self.events[: -self.keep]
        for listen in list(self.listeners):
            listen(event)

    def kinds(self, group: str | None = None) -> list[str]:
        return [e.kind for e in self.events if group in (None, e.group)]

    def last(self, group: str = "read") -> Event | None:
        return next((e for e in reversed(self.events) if e.group == group), None)


def fingerprint(p: Predicate | None) -> str:
    """Filters of one shape, whatever their literals, have one fingerprint."""
    return hashlib.sha256(shape(p).encode()).hexdigest()[:16]
