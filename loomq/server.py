"""A TCP server: each connection logs in, then sends SQL and gets result dicts as JSON, in a session of its own.

A message is a little-endian u32 length and that many bytes of UTF-8, 16 MiB at most. `.quit` ends a connection. What a
connection leaves open is rolled back. While no user exists, no log-in is asked for.

A client whose first message holds "parts": true gets results of any size, in messages that say `more` while another
follows; others get an error for what does not fit one message. The server holds one part at a time.
"""

from __future__ import annotations

import json
import socket
import socketserver
import struct
import threading

from . import answers as A
from .session import Engine

#: Fixed values of the wire format.
LENGTH, MOST = struct.Struct("<I"), 16 << 20
PORT = 5433
#: Bytes of rows in one part of a result; one row and the columns' names must fit into the rest of a message.
PART = 4 << 20


def send(sock: socket.socket, text: str) -> None:
    data = text.encode()
    if len(data) > MOST:
        raise ValueError(A.TOO_LARGE.format(f"{len(data)} bytes"))
    sock.sendall(LENGTH.pack(len(data)) + data)


def _exactly(sock: socket.socket, n: int) -> bytes:
    parts, left = [], n
    while left:
        part = sock.recv(min(left, 1 << 16))
        if not part:
            raise ConnectionError("the other side closed the connection")
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def receive(sock: socket.socket) -> str:
    (n,) = LENGTH.unpack(_exactly(sock, LENGTH.size))
    if n > MOST:
        raise ValueError(A.TOO_LARGE.format(f"{n} bytes"))
    return _exactly(sock, n).decode()


class _Connection(socketserver.BaseRequestHandler):
    def handle(self) -> None:
        engine: Engine = self.server.engine
        session = engine.session()
        try:
            first = receive(self.request)
            if not self._log_in(engine, first):
                return
            while True:
                sql, first = (first if first is not None and not self._greets(first) else receive(self.request)).strip(), None
                if sql.lower() == ".quit":
                    return self._reply({"columns": [], "rows": [], "message": A.GOODBYE})
                if not sql:
                    self._reply({"columns": [], "rows": [], "message": ""})
                    continue
                if self.parts:
                    for part in session.parts(sql, PART):
                        self._reply(part)
                    continue
                try:
                    self._reply(session.execute(sql, MOST))
                except ValueError as e:  # too large to send
                    self._reply({"columns": [], "rows": [], "message": f"Error: {e}"})
        except (ConnectionError, ValueError, OSError):
            return  # the client is gone or does not speak the protocol
        finally:
            session.rollback()

    def _reply(self, value: dict) -> None:
        send(self.request, json.dumps(value, default=str, ensure_ascii=False))

    parts = False

    def _greets(self, message: str) -> dict | None:
        """A first message that is not SQL: it holds credentials, or asks for parts."""
        try:
            asked = json.loads(message)
        except json.JSONDecodeError:
            return None
        return asked if isinstance(asked, dict) and asked.keys() & {"auth", "parts"} else None

    def _log_in(self, engine: Engine, first: str) -> bool:
        asked = self._greets(first)
        self.parts = bool(asked and asked.get("parts"))
        if not engine.users.names():
            if asked:
                self._reply({"ok": True, "message": "No users"})
            return True
        try:
            user, password = asked["auth"]["username"], asked["auth"]["password"]
            if not isinstance(user, str) or not isinstance(password, str):
                raise TypeError
        except (KeyError, TypeError):
            self._reply({"ok": False, "message": A.EXPECTED_AUTH})
            return False
        ok = engine.users.accepts(user, password)
        self._reply({"ok": ok, "message": A.AUTHENTICATED.format(user) if ok else A.REFUSED})
        return ok


class Server(socketserver.ThreadingTCPServer):
    """Server(engine, host, port).start() serves from threads until stop(). Port 0 takes a free one; see .port."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = PORT):
        self.engine = engine
        super().__init__((host, port), _Connection)

    @property
    def port(self) -> int:
        return self.server_address[1]

    def start(self) -> Server:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.shutdown()
        self.server_close()
