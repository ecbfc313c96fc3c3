import json
import socket
import threading
import urllib.request

import pytest

from quillstore.server import Server
from quillstore.store import Store


@pytest.mark.parametrize(("host", "url"), [("127.0.0.1", "127.0.0.1"), ("::1", "[::1]")])
def test_either_version_of_the_address(spark, tmp_path, host, url):
    try:
        socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET).bind((host, 0))
    except OSError:
        pytest.skip("no such address here")
    with Store(spark, str(tmp_path)) as store, Server((host, 0), store) as server:
        thread = threading.Thread(target=server.serve_forever, daemon=True)
        thread.start()
        try:
            with urllib.request.urlopen(f"http://{url}:{server.server_address[1]}/health", timeout=30) as answer:
                assert json.load(answer) == {"ok": True}
        finally:
            server.shutdown()
