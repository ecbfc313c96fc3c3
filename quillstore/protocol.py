"""HTTP requests as values: reading them from bytes, and answering them from a store. No sockets here."""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable
from dataclasses import dataclass

from .functions import jsontext
from .functions.urltext import percent_decoded
from .operators.listing import InvalidRequest
from .store import Store

# Fixed values of the protocol.
MAX_HEAD = 16_384
MAX_BODY = jsontext.MAX_DOC_BYTES + 65_536
DEFAULT_LIMIT = 100
REASONS = {200: "OK", 400: "Bad Request", 401: "Unauthorized", 404: "Not Found", 405: "Method Not Allowed", 413: "Payload Too Large", 431: "Request Header Fields Too Large", 500: "Internal Server Error", 501: "Not Implemented"}


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Request:
    method: str
    path: tuple[str, ...]
    query: tuple[tuple[str, str], ...] = ()
    headers: tuple[tuple[str, str], ...] = ()
    body: bytes = b""

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


@dataclass(frozen=True)
class Response:
    status: int
    body: str

    def to_bytes(self) -> bytes:
        body = self.body.encode()
        head = f"HTTP/1.1 {self.status} {REASONS[self.status]}\r\nContent-Type: application/json\r\nContent-Length: {len(body)}\r\nConnection: close\r\n\r\n"
        return head.encode() + body


def _answer(**members: str) -> Response:
    """200 with ``members``, whose values are JSON text already."""
    return Response(200, "{" + ",".join(f'"{k}":{v}' for k, v in {"ok": "true", **members}.items()) + "}")


def refusal(status: int, message: str) -> Response:
    return Response(status, '{"ok":false,"error":' + jsontext.quote(message) + "}")


_LINE = re.compile(r"([^ ]*) ([^ ]*) HTTP/1\.[^ ]*")
_LENGTH = re.compile(r"\+?[0-9]+")


def read_request(receive: Callable[[int], bytes]) -> Request:
    """One request from ``receive(n)``, which gives at most n bytes and none at the end. Raises Refused."""
    raw = b""
    while b"\r\n\r\n" not in raw and len(raw) <= MAX_HEAD:
        more = receive(4096)
        if not more:
            raise Refused(400, "the request broke off")
        raw += more
    head, ended, body = raw.partition(b"\r\n\r\n")
    if not ended or len(head) > MAX_HEAD:
        raise Refused(431, "request line and headers are too long")
    try:
        first, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError:
        raise Refused(400, "the head is no UTF-8") from None
    line = _LINE.fullmatch(first)
    if not line:
        raise Refused(400, "the request line is malformed")
    if not all(":" in x for x in lines):
        raise Refused(400, "a header is malformed")
    request = Request(line[1], (), (), tuple((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)))
    if request.header("Transfer-Encoding") is not None:
        raise Refused(501, "only bodies with a Content-Length are read")
    length = "0" if (given := request.header("Content-Length")) is None else given
    if not _LENGTH.fullmatch(length) or int(length) >= 1 << 64:
        raise Refused(400, "Content-Length is malformed")
    size = int(length)
    if size > MAX_BODY:
        raise Refused(413, "the body is too large")
    path, query = target(line[2])
    if len(body) > size:
        raise Refused(400, "the body is longer than Content-Length")
    while len(body) < size:
        more = receive(min(65536, size - len(body)))
        if not more:
            raise Refused(400, "the body broke off")
        body += more
    return Request(request.method, path, query, request.headers, body)


def target(text: str) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """Path segments (empty ones dropped) and query pairs of a request target."""
    where, _, query = text.partition("?")
    path = tuple(percent_decoded(s) for s in where.split("/") if s)
    pairs = tuple(tuple(percent_decoded(x, query=True) for x in p.partition("=")[::2]) for p in query.split("&") if p)
    if None in path or any(None in p for p in pairs):
        raise Refused(400, "the target has a bad escape")
    return path, pairs


def respond(request: Request, store: Store, token: str | None = None) -> Response:
    """The answer to a request."""
    try:
        return _routed(request, store, token)
    except Refused as e:
        return refusal(e.status, str(e))
    except InvalidRequest as e:
        return refusal(400, str(e))
    except Exception as e:  # noqa: BLE001  what Spark or the disk refuses
        return refusal(500, f"{type(e).__name__}: the store failed")


def _routed(request: Request, store: Store, token: str | None) -> Response:
    method, path = request.method, request.path
    if path == ("health",):
        return _answer() if method == "GET" else _refuse(405, "only GET")
    if token is not None:
        kind, given = (request.header("Authorization") or "")[:7], (request.header("Authorization") or "")[7:]
        if kind != "Bearer " or not hmac.compare_digest(given.encode(), token.encode()):
            _refuse(401, "a bearer token is needed")
    shape = (len(path), *[p for p, want in zip(path[::2], ("collections", "docs")) if p == want])
    endpoint = {(1, "collections"): "names", (3, "collections", "docs"): "listing", (4, "collections", "docs"): "document"}.get(shape)
    if endpoint is None:
        _refuse(404, "no such endpoint")
    act = _ACTIONS.get((method, endpoint))
    if act is None:
        _refuse(405, "no such method here")
    return act(store, request, *path[1::2])


def _refuse(status: int, message: str):
    raise Refused(status, message)


def _names(store: Store, request: Request) -> Response:
    return _answer(collections="[" + ",".join(f'{{"name":{jsontext.quote(n)},"documents":{k}}}' for n, k in store.collections()) + "]")


def _put(store: Store, request: Request, collection: str, id: str) -> Response:
    try:
        text = request.body.decode()
        jsontext.parse(text)
    except UnicodeDecodeError:
        _refuse(400, "the body is no UTF-8")
    except jsontext.JsonTextError as e:
        _refuse(400, f"the body is no JSON: {e}")
    store.put(collection, id, text)
    return _answer()


def _get(store: Store, request: Request, collection: str, id: str) -> Response:
    doc = store.get(collection, id)
    return _answer(id=jsontext.quote(id), doc=doc) if doc is not None else _refuse(404, "no such document")


def _delete(store: Store, request: Request, collection: str, id: str) -> Response:
    return _answer(deleted="true" if store.delete(collection, id) else "false")


def _list(store: Store, request: Request, collection: str) -> Response:
    filters, after, limit = [], None, DEFAULT_LIMIT
    for name, value in request.query:
        if name.startswith("where."):
            filters.append((name[len("where.") :], value))
        elif name == "after":
            after = value
        elif name == "limit":
            if not _LENGTH.fullmatch(value):
                _refuse(400, "limit is no number")
            limit = int(value)
        else:
            _refuse(400, f"unknown parameter {name}")
    docs, following = store.list(collection, filters, after, limit)
    return _answer(docs="[" + ",".join(f'{{"id":{jsontext.quote(i)},"doc":{d}}}' for i, d in docs) + "]", next="null" if following is None else jsontext.quote(following))


_ACTIONS = {("GET", "names"): _names, ("GET", "listing"): _list, ("PUT", "document"): _put, ("GET", "document"): _get, ("DELETE", "document"): _delete}
