"""A small REST service over the TCP server: to-dos, kept in one table, through a pool of connections.

    GET /todos    POST /todos    GET, PUT, DELETE /todos/ID        bodies and answers are JSON

    python -m loomq --data /tmp/todos --server          # in another terminal
    python examples/todos.py --username bob --password pw
"""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomq.client import Client, ConnectionPool  # noqa: E402

FIELDS = {"title": str, "description": str, "completed": bool}
COLUMNS = ["id", *FIELDS]


def literal(value: object) -> str:
    """A JSON value as a literal of the dialect, which has no parameters: quotes are doubled, nothing else is special."""
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def run(db: Client, sql: str) -> list[dict]:
    answer = db.execute(sql)
    if "rror: " in answer["message"]:
        raise ValueError(answer["message"])
    return [dict(zip(answer["columns"], row, strict=True)) for row in answer["rows"]]


class Todos:
    def __init__(self, pool: ConnectionPool):
        self.pool = pool
        with pool.connection() as db:
            message = db.execute("CREATE TABLE todos (id INTEGER PRIMARY KEY, title TEXT NOT NULL, description TEXT, completed BOOLEAN NOT NULL)")["message"]
            if "created" not in message and "already exists" not in message:
                raise RuntimeError(message)

    @staticmethod
    def checked(body: dict, whole: bool) -> dict:
        if unknown := set(body) - set(FIELDS):
            raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
        for name, kind in FIELDS.items():
            if body.get(name) is not None and not isinstance(body[name], kind):
                raise ValueError(f"{name} must be of type {kind.__name__}")
        if whole and not body.get("title"):
            raise ValueError("title is needed")
        return ({"completed": False} if whole else {}) | body

    def all(self) -> list[dict]:
        with self.pool.connection() as db:
            return run(db, f"SELECT {', '.join(COLUMNS)} FROM todos ORDER BY id")

    def one(self, key: int) -> dict | None:
        with self.pool.connection() as db:
            return next(iter(run(db, f"SELECT {', '.join(COLUMNS)} FROM todos WHERE id = {key}")), None)

    def add(self, body: dict) -> dict:
        body = self.checked(body, True)
        with self.pool.connection() as db:  # in one transaction, so that the largest id is the one just given
            run(db, "BEGIN")
            run(db, f"INSERT INTO todos ({', '.join(body)}) VALUES ({', '.join(map(literal, body.values()))})")
            (new,) = run(db, f"SELECT {', '.join(COLUMNS)} FROM todos ORDER BY id DESC LIMIT 1")
            run(db, "COMMIT")
        return new

    def change(self, key: int, body: dict) -> dict | None:
        if sets := ", ".join(f"{k} = {literal(v)}" for k, v in self.checked(body, False).items()):
            with self.pool.connection() as db:
                run(db, f"UPDATE todos SET {sets} WHERE id = {key}")
        return self.one(key)

    def remove(self, key: int) -> bool:
        with self.pool.connection() as db:
            return db.execute(f"DELETE FROM todos WHERE id = {key}")["message"].startswith("1 ")


class Handler(BaseHTTPRequestHandler):
    todos: Todos

    def answer(self, status: int, value: object = None) -> None:
        data = b"" if value is None else json.dumps(value).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def serve(self) -> None:
        parts = self.path.strip("/").split("/")
        if parts[0] != "todos" or len(parts) > 2 or (len(parts) == 2 and not parts[1].isdigit()):
            return self.answer(404, {"error": "no such path"})
        key = int(parts[1]) if len(parts) == 2 else None
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            match self.command, key:
                case "GET", None:
                    return self.answer(200, self.todos.all())
                case "POST", None:
                    return self.answer(201, self.todos.add(body))
                case "GET", int():
                    found = self.todos.one(key)
                case "PUT", int():
                    found = self.todos.change(key, body)
                case "DELETE", int():
                    return self.answer(204) if self.todos.remove(key) else self.answer(404, {"error": "no such to-do"})
                case _:
                    return self.answer(405, {"error": "not allowed here"})
            return self.answer(200, found) if found else self.answer(404, {"error": "no such to-do"})
        except ValueError as e:
            return self.answer(400, {"error": str(e)})

    do_GET = do_POST = do_PUT = do_DELETE = serve

    def log_message(self, *_: object) -> None:
        pass


def service(pool: ConnectionPool, port: int) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), type("TodoHandler", (Handler,), {"todos": Todos(pool)}))


if __name__ == "__main__":
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--username", required=True)
    options.add_argument("--password", required=True)
    options.add_argument("--database-port", type=int, default=5433)
    options.add_argument("--port", type=int, default=8080)
    given = options.parse_args()
    service(ConnectionPool(port=given.database_port, username=given.username, password=given.password), given.port).serve_forever()
