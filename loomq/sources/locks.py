"""Table locks: many readers or one writer, held to the end of a transaction, with a time limit."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from ..errors import ExecutionError

#: Fixed value: seconds to wait before a wait counts as a deadlock.
TIMEOUT = 5.0


class TableLocks:
    def __init__(self, timeout: float = TIMEOUT):
        self.timeout = timeout
        self._free = threading.Condition()
        self._readers: dict[str, set[object]] = defaultdict(set)
        self._writer: dict[str, object] = {}

    def _wait(self, table: str, fits) -> None:
        ends = time.monotonic() + self.timeout
        while not fits():
            left = ends - time.monotonic()
            if left <= 0:
                raise ExecutionError(f"Lock timeout on table '{table}' (possible deadlock)")
            self._free.wait(left)

    def read(self, table: str, owner: object) -> None:
        with self._free:
            self._wait(table, lambda: self._writer.get(table, owner) is owner)
            self._readers[table].add(owner)

    def write(self, table: str, owner: object) -> None:
        with self._free:
            self._wait(table, lambda: self._writer.get(table, owner) is owner and self._readers[table] <= {owner})
            self._writer[table] = owner

    def release(self, owner: object) -> None:
        with self._free:
            for table in [t for t, o in self._writer.items() if o is owner]:
                del self._writer[table]
            for readers in self._readers.values():
                readers.discard(owner)
            self._free.notify_all()
