"""A client of the TCP server, and a pool of clients for threads to share."""

from __future__ import annotations

import json
import queue
import socket
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from .answers import REFUSED
from .server import PORT, receive, send


class Client:
    """A connection. Without a user name it logs in nowhere, as a server without users lets it."""

    def __init__(self, host: str = "127.0.0.1", port: int = PORT, *, username: str | None = None, password: str | None = None, timeout: float | None = None):
        self._sock: socket.socket | None = socket.create_connection((host, port), timeout)
        auth = {"auth": {"username": username, "password": password or ""}} if username is not None else {}
        try:
            send(self._sock, json.dumps(auth | {"parts": True}))
            answer = json.loads(receive(self._sock))
        except BaseException:
            self._drop()
            raise
        if not answer.get("ok"):
            self._drop()
            raise ConnectionError(answer.get("message", REFUSED))

    def _drop(self) -> None:
        if self._sock:
            self._sock.close()
        self._sock = None

    @property
    def closed(self) -> bool:
        return self._sock is None

    @property
    def connected(self) -> bool:
        return self._sock is not None

    def parts(self, sql: str) -> Iterator[dict]:
        """The result part by part, so that one of any size passes; to be taken to its end."""
        if self._sock is None:
            raise ConnectionError("this client was closed before")
        try:
            send(self._sock, sql)
            more = True
            while more:
                part = json.loads(receive(self._sock))
                more = part.pop("more", False)
                yield part
        except (OSError, ConnectionError):
            self._drop()
            raise

    def execute(self, sql: str) -> dict:
        """The whole result."""
        found = list(self.parts(sql))
        return found[-1] | {"rows": [r for p in found for r in p["rows"]]}

    def close(self) -> None:
        if self._sock:
            try:
                send(self._sock, ".quit")
                receive(self._sock)
            except (OSError, ConnectionError):
                pass
            self._drop()

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class ConnectionPool:
    """At most max_size clients, min_size of them open from the start. acquire waits up to `wait` seconds for one."""

    def __init__(self, host: str = "127.0.0.1", port: int = PORT, *, min_size: int = 2, max_size: int = 10, wait: float = 30.0, username: str | None = None, password: str | None = None):
        self._open = lambda: Client(host, port, username=username, password=password)
        self._wait, self._closed = wait, False
        self._idle: queue.LifoQueue[Client] = queue.LifoQueue()
        self._slots = threading.Semaphore(max_size)
        for _ in range(min(min_size, max_size)):
            self._idle.put(self._open())

    def acquire(self) -> Client:
        if self._closed:
            raise RuntimeError("the pool takes no more work: it was closed")
        if not self._slots.acquire(timeout=self._wait):
            raise TimeoutError(f"no connection became free in {self._wait} s")
        try:
            while True:
                try:
                    client = self._idle.get_nowait()
                except queue.Empty:
                    return self._open()
                if not client.closed:
                    return client
        except BaseException:
            self._slots.release()
            raise

    def release(self, client: Client) -> None:
        """Takes a client back; what it has left open is rolled back."""
        try:
            if not client.closed and not self._closed:
                client.execute("ROLLBACK")
                self._idle.put(client)
            else:
                client.close()
        except (OSError, ConnectionError):
            pass
        finally:
            self._slots.release()

    @contextmanager
    def connection(self) -> Iterator[Client]:
        client = self.acquire()
        try:
            yield client
        finally:
            self.release(client)

    def close(self) -> None:
        self._closed = True
        while not self._idle.empty():
            self._idle.get_nowait().close()
