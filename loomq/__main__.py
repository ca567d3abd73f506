"""python -m loomq --data FOLDER [--server] [--port N]: the shell, or the TCP server, on a local SparkSession."""

from __future__ import annotations

import argparse
import getpass
import threading

from pyspark.sql import SparkSession

from .repl import Shell
from .server import PORT, Server
from .session import Engine


def main() -> None:
    options = argparse.ArgumentParser(prog="loomq", description=__doc__)
    options.add_argument("--data", required=True, help="folder of the tables, on any file system that Spark reaches")
    options.add_argument("--server", action="store_true", help="serve over TCP instead of the shell")
    options.add_argument("--host", default="127.0.0.1")
    options.add_argument("--port", type=int, default=PORT)
    given = options.parse_args()
    spark = SparkSession.builder.appName("loomq").getOrCreate()
    with Engine(spark, given.data) as engine:
        if not given.server:
            return Shell(engine).run()
        if not engine.users.names():
            engine.users.change("CREATE", input("First user: "), getpass.getpass("Password: "))
        server = Server(engine, given.host, given.port).start()
        print(f"TCP server on {given.host}:{server.port}")
        threading.Event().wait()


if __name__ == "__main__":
    main()
