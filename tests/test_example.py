import json
import sys
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest

from loomq.client import ConnectionPool
from loomq.server import Server
from loomq.session import Engine

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "examples"))


@pytest.fixture
def call(spark, tmp_path):
    import todos

    with Engine(spark, str(tmp_path / "db")) as engine:
        engine.execute("CREATE USER bob IDENTIFIED BY 'pw'")
        server = Server(engine, port=0).start()
        pool = ConnectionPool(port=server.port, username="bob", password="pw")
        web = todos.service(pool, 0)
        threading.Thread(target=web.serve_forever, daemon=True).start()

        def request(method, path, body=None):
            data = None if body is None else json.dumps(body).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", data, method=method)) as r:
                    return r.status, json.loads(r.read() or b"null")
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read() or b"null")

        yield request
        web.shutdown()
        pool.close()
        server.stop()


def test_to_dos_over_http(call):
    assert call("GET", "/todos") == (200, [])
    first = {"id": 1, "title": "it's", "description": None, "completed": False}
    assert call("POST", "/todos", {"title": "it's"}) == (201, first)
    assert call("POST", "/todos", {"title": "b", "completed": True, "description": "'; DROP TABLE todos; --"})[1]["id"] == 2
    assert call("GET", "/todos/1") == (200, first)
    assert call("PUT", "/todos/1", {"completed": True}) == (200, first | {"completed": True})
    assert [t["id"] for t in call("GET", "/todos")[1]] == [1, 2]
    assert call("DELETE", "/todos/2") == (204, None) and call("DELETE", "/todos/2")[0] == 404
    assert call("GET", "/todos/2")[0] == call("PUT", "/todos/2", {"title": "x"})[0] == call("GET", "/nothing")[0] == 404
    assert call("POST", "/todos", {})[0] == call("POST", "/todos", {"title": 5})[0] == call("PUT", "/todos/1", {"no": 1})[0] == 400
    assert call("PUT", "/todos", {})[0] == 405
