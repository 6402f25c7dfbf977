import hashlib
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillspark.sources.model import ensure_model, sha256_hex

DATA = bytes(range(256)) * 20_000


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            first = int((self.headers["Range"] or "bytes=0-")[6:-1])
            asked.append(first)
            whole = self.path == "/whole"
            if first >= len(DATA) and not whole:
                self.send_error(416)
                return
            body = DATA if whole else DATA[first:]
            self.send_response(206 if first and not whole else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


@pytest.mark.parametrize(("path", "have", "first"), [("/m", 0, 0), ("/m", 1000, 1000), ("/m", len(DATA), len(DATA)), ("/whole", 1000, 1000)])
def test_download_goes_on(tmp_path, server, path, have, first):
    url, asked = server
    want = hashlib.sha256(DATA).hexdigest()
    target = tmp_path / "d" / "m.bin"
    target.parent.mkdir()
    if have:
        (target.parent / "m.bin.part").write_bytes(DATA[:have])
    assert ensure_model(url + path, target, want) == target
    assert sha256_hex(target) == want and asked == [first] and list(target.parent.iterdir()) == [target]
    assert ensure_model("http://127.0.0.1:1/none", target, want) == target  # there already


def test_wrong_checksum(tmp_path, server):
    with pytest.raises(ValueError, match="SHA-256"):
        ensure_model(server[0] + "/m", tmp_path / "m", "0" * 64)
    assert list(tmp_path.iterdir()) == []
