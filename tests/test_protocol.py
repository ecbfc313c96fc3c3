import io
import json
import socket
import threading

import pytest

from quillstore import __main__ as cli
from quillstore import protocol as P
from quillstore.server import Server
from quillstore.store import Store


def read(raw: bytes) -> P.Request:
    return P.read_request(io.BytesIO(raw).read)


def test_a_request_is_read():
    r = read(b"PUT /collections//a%20b/docs/x+y/?where.a.b=1+2&after=%C3%A9&flag HTTP/1.1\r\nHost: h\r\ncontent-LENGTH: 4\r\n\r\nbody")
    assert (r.method, r.path, r.body) == ("PUT", ("collections", "a b", "docs", "x+y"), b"body")
    assert r.query == (("where.a.b", "1 2"), ("after", "é"), ("flag", ""))
    assert r.header("HOST") == "h"


@pytest.mark.parametrize(
    ("raw", "status"),
    [
        (b"", 400), (b"GET / HTTP/1.1\r\n", 400), (b"GET /\r\n\r\n", 400), (b"GET / HTTP/2\r\n\r\n", 400), (b"GET / x HTTP/1.1\r\n\r\n", 400), (b"GET / HTTP/1.1\r\nnocolon\r\n\r\n", 400),
        (b"GET /%zz HTTP/1.1\r\n\r\n", 400), (b"GET /?a=%f HTTP/1.1\r\n\r\n", 400), (b"GET / HTTP/1.1\r\nContent-Length: x\r\n\r\n", 400), (b"GET / HTTP/1.1\r\nContent-Length: 5\r\n\r\nabc", 400),
        (b"GET / HTTP/1.1\r\nContent-Length: 1\r\n\r\nabc", 400), (b"GET / HTTP/1.1\r\n\xff: 1\r\n\r\n", 400), (b"PUT / HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n", 501),
        (b"PUT / HTTP/1.1\r\nContent-Length: 99999999\r\n\r\n", 413), (b"GET / HTTP/1.1\r\nA: " + b"x" * 20_000 + b"\r\n\r\n", 431), (b"x" * 20_000, 431),
    ],
)
def test_malformed_requests(raw, status):
    with pytest.raises(P.Refused) as e:
        read(raw)
    assert e.value.status == status


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    with Store(spark, str(tmp_path_factory.mktemp("http"))) as s:
        yield s


def ask(store, method, path, body=b"", token=None, headers=()):
    segments, query = P.target(path)
    answer = P.respond(P.Request(method, segments, query, tuple(headers), body), store, token)
    return answer.status, json.loads(answer.body)


def test_routes(store):
    assert ask(store, "GET", "/health") == (200, {"ok": True})
    assert ask(store, "POST", "/health", token="t")[0] == 405
    assert ask(store, "GET", "/nowhere", token="t")[0] == 401
    bearer = [("authorization", "Bearer t")]
    assert ask(store, "GET", "/nowhere", token="t", headers=bearer)[0] == 404
    assert ask(store, "GET", "/collections", token="t", headers=[("Authorization", "bearer t")])[0] == 401
    assert ask(store, "PUT", "/collections/n/docs/n1", b'{"topic": "storage","words":12.50}') == (200, {"ok": True})
    assert ask(store, "PUT", "/collections/n/docs/n2", b'{"topic":"storage"}')[0] == 200
    assert ask(store, "GET", "/collections/n/docs/n1")[1]["doc"] == {"topic": "storage", "words": 12.5}
    status, page = ask(store, "GET", "/collections/n/docs?where.topic=storage&limit=1")
    assert (status, page["next"], [d["id"] for d in page["docs"]]) == (200, "n1", ["n1"])
    assert ask(store, "GET", "/collections/n/docs/?after=n1")[1]["next"] is None
    assert ask(store, "GET", "/collections")[1]["collections"] == [{"name": "n", "documents": 2}]
    assert ask(store, "DELETE", "/collections/n/docs/n2")[1] == {"ok": True, "deleted": True}
    assert ask(store, "DELETE", "/collections/n/docs/n2")[1] == {"ok": True, "deleted": False}


@pytest.mark.parametrize(
    ("method", "path", "body", "status"),
    [
        ("GET", "/collections/n/docs/none", b"", 404), ("GET", "/collections/b!d/docs/x", b"", 404), ("GET", "/collections/b!d/docs", b"", 400), ("DELETE", "/collections/b!d/docs/x", b"", 400),
        ("PUT", "/collections/b!d/docs/x", b"{}", 400), ("PUT", "/collections/n/docs/x", b"[1]", 400), ("PUT", "/collections/n/docs/x", b"{", 400), ("PUT", "/collections/n/docs/x", b"\xff", 400),
        ("PUT", "/collections/n/docs/%01", b"{}", 400), ("GET", "/collections/n/docs?sort=a", b"", 400), ("GET", "/collections/n/docs?where=a", b"", 400), ("GET", "/collections/n/docs?limit=0", b"", 400),
        ("GET", "/collections/n/docs?limit=1001", b"", 400), ("GET", "/collections/n/docs?limit=x", b"", 400), ("GET", "/collections/none/docs", b"", 200), ("GET", "/collections/n", b"", 404),
        ("POST", "/collections", b"", 405), ("POST", "/collections/n/docs", b"", 405), ("POST", "/collections/n/docs/x", b"", 405), ("GET", "/collections?x=1", b"", 200), ("GET", "/", b"", 404),
    ],
)
def test_statuses(store, method, path, body, status):
    assert ask(store, method, path, body)[0] == status


def test_over_a_socket(store):
    with Server(("127.0.0.1", 0), store, "t") as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address) as s:
            s.sendall(b"GET /health HTTP/1.1\r\n\r\n")
            raw = b"".join(iter(lambda: s.recv(4096), b""))
        server.shutdown()
    assert raw.startswith(b"HTTP/1.1 200 OK\r\n") and raw.endswith(b'{"ok":true}')


def test_command_line(capsys):
    assert cli.main(["version"]) == 0 and cli.main([]) == 0
    assert cli.main(["serve", "--bind", "0.0.0.0"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["unknown"])
    assert e.value.code == 2
