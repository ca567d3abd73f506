"""An interactive shell: statements up to their semicolon, and commands that begin with a dot."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from .errors import LoomError
from .server import PORT, Server
from .session import Engine

HELP = """\
.help             this text
.tables           tables
.schema TABLE     columns and indexes of a table
.indexes          all indexes
.server [PORT]    serve over TCP from here on
.quit             leave (also .exit)
Statements end with a semicolon and may take several lines."""


def boxed(columns: list[str], rows: list[list]) -> str:
    """A result as a table in ASCII; NULL for None."""
    if not columns:
        return ""
    cells = [[str(c) for c in columns], *[["NULL" if v is None else str(v) for v in row] for row in rows]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    rule = "+".join(["", *("-" * (w + 2) for w in widths), ""])
    line = lambda row: "|".join(["", *(f" {v:<{w}} " for v, w in zip(row, widths, strict=True)), ""])
    return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule])


class Shell:
    prompt, more = "loomq> ", "   ...> "

    def __init__(self, engine: Engine, out: TextIO = sys.stdout):
        self.engine, self.session, self.out = engine, engine.session(), out
        self.server: Server | None = None
        self.pending = ""

    def say(self, text: str) -> None:
        if text:
            print(text, file=self.out)

    def feed(self, line: str) -> bool:
        """Takes one line; False when it ends the shell."""
        if not self.pending and line.strip().startswith("."):
            return self.command(line.split())
        self.pending = f"{self.pending}\n{line}" if self.pending else line
        if self.pending.rstrip().endswith(";"):
            sql, self.pending = self.pending, ""
            result = self.session.execute(sql)
            self.say(boxed(result["columns"], result["rows"]))
            self.say(result["message"])
        return True

    def command(self, words: list[str]) -> bool:
        match words:
            case [".quit" | ".exit"]:
                return False
            case [".help"]:
                self.say(HELP)
            case [".tables"]:
                self.say("\n".join(f"  {t}" for t in self.engine.tables()) or "(no tables)")
            case [".schema", table]:
                self.say(self.schema(table))
            case [".schema", *_]:
                self.say("Usage: .schema TABLE")
            case [".indexes"]:
                store = self.engine.store
                found = [f"  {i.name} ON {t} {'UNIQUE ' if i.unique else ''}({', '.join(i.columns)})" for t in (store.names() if store else ()) for i in store.get(t).indexes]
                self.say("\n".join(found) or "(no indexes)")
            case [".server", *port]:
                if self.server:
                    self.say("Server already running")
                else:
                    self.server = Server(self.engine, port=int(port[0]) if port else PORT).start()
                    self.say(f"TCP server started on port {self.server.port}")
            case _:
                self.say(f"Unknown command: {words[0]}  (try .help)")
        return True

    def schema(self, table: str) -> str:
        try:
            if self.engine.store and table.lower() in self.engine.store.paths:
                m = self.engine.store.get(table)
                lines = [f"  {c.name:20} {c.type:10} {'PRIMARY KEY' if c.primary else '' if c.nullable else 'NOT NULL'}".rstrip() for c in m.columns]
                lines += ["Indexes:"] * bool(m.indexes) + [f"  {i.name}: {'UNIQUE ' if i.unique else ''}({', '.join(i.columns)})" for i in m.indexes]
                return "\n".join([f"Table: {m.name}", *lines])
            fields = self.session.read(table).schema.fields
            return "\n".join([f"Table: {table} (read-only)", *(f"  {f.name:20} {f.dataType.simpleString()}" for f in fields)])
        except LoomError as e:
            return f"Error: {e}"

    def close(self) -> None:
        self.session.rollback()
        if self.server:
            self.server.stop()
            self.server = None

    def run(self, lines: Iterable[str] | None = None) -> None:
        try:
            if lines is not None:
                all(self.feed(x.rstrip("\n")) for x in lines)
                return
            going = True
            while going:
                try:
                    going = self.feed(input(self.more if self.pending else self.prompt))
                except EOFError:
                    going = False
        finally:
            self.close()
