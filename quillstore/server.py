"""The HTTP facade: one request a connection, threads up to a bound."""

from __future__ import annotations

import socket
import socketserver
import threading

from . import protocol
from .store import Store

# Fixed values of the protocol.
MAX_CONNECTIONS = 128
TIMEOUT_SECONDS = 30


class _Handler(socketserver.BaseRequestHandler):
    def handle(self) -> None:
        self.request.settimeout(TIMEOUT_SECONDS)
        try:
            try:
                request = protocol.read_request(self.request.recv)
            except protocol.Refused as e:
                answer = protocol.refusal(e.status, str(e))
            except OSError:
                answer = protocol.refusal(400, "the request didn't arrive")
            else:
                # One request at a time reaches the store, as one process writes at a time.
                with self.server.turn:
                    answer = protocol.respond(request, self.server.store, self.server.token)
            self.request.sendall(answer.to_bytes())
        except OSError:
            pass  # the client is gone


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, address: tuple[str, int], store: Store, token: str | None = None):
        # An address with colons is one of the sixth version.
        self.address_family = socket.AF_INET6 if ":" in address[0] else socket.AF_INET
        super().__init__(address, _Handler)
        self.store, self.token = store, token
        self.turn = threading.Lock()
        self._free = threading.BoundedSemaphore(MAX_CONNECTIONS)

    def verify_request(self, request, client_address) -> bool:
        return self._free.acquire(blocking=False)

    def process_request_thread(self, request, client_address) -> None:
        try:
            super().process_request_thread(request, client_address)
        finally:
            self._free.release()
