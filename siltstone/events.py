"""Events of a run: typed, published to all subscribers in the publisher's thread, one at a time."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class FileStart:
    path: str


@dataclass(frozen=True)
class FileFinish:
    path: str
    before: int
    after: int
    replaced: bool


@dataclass(frozen=True)
class FileSkipped:
    path: str
    reason: str


@dataclass(frozen=True)
class FileError:
    path: str
    message: str


@dataclass(frozen=True)
class Log:
    level: str
    message: str


class EventBus:
    def __init__(self):
        self._lock, self._handlers = threading.RLock(), {}

    def subscribe(self, kind: type, handler: Callable) -> None:
        with self._lock:
            self._handlers.setdefault(kind, []).append(handler)

    def publish(self, event) -> None:
        with self._lock:
            for handler in self._handlers.get(type(event), ()):
                handler(event)

    def wants(self, *kinds: type) -> bool:
        return any(self._handlers.get(k) for k in kinds)
