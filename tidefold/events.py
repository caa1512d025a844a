"""Callbacks for named events. Scans raise one event for each query, not one a row."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

#: Names of the events.
NAMES = (
    "ready", "get", "put", "delete", "exists", "get-keys", "get-keys-end", "get-count", "get-query", "get-query-end",
    "get-all", "get-all-end", "get-offset", "get-offset-end", "get-range", "get-range-end", "read-stream",
    "read-stream-end", "read-key-stream", "read-key-stream-end", "read-value-stream", "read-value-stream-end",
    "tx-start", "tx-end", "tx-abort", "close", "clear", "compact-start", "compact-end",
)


class Events:
    def __init__(self):
        self._callbacks: dict[str, list[Callable]] = defaultdict(list)

    def on(self, event: str, callback: Callable) -> None:
        if event not in NAMES:
            raise ValueError(f"no such event: {event}")
        self._callbacks[event].append(callback)

    def off(self, event: str, callback: Callable) -> None:
        if callback in self._callbacks[event]:
            self._callbacks[event].remove(callback)

    def trigger(self, event: str, *args) -> None:
        for callback in list(self._callbacks[event]):
            callback(*args)
