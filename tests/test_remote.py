"""Remote scans against a server in this process."""

import http.server
import io
import json
import threading
import zipfile

import pytest

from siltworks.operators.external import NEEDS, Unavailable, external
from siltworks.sources import catalogue, remote


#: Client address and authorisation of every request.
seen = []


@pytest.fixture(scope="module")
def server():
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "x" * 100_000)
    data, failures = archive.getvalue(), {"n": 0}
    seen.clear()

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        protocol_version = "HTTP/1.1"

        def do_GET(self):
            seen.append((self.client_address, self.headers.get("Authorization")))
            if self.path.startswith("/flaky") and failures["n"] < 1:
                failures["n"] += 1
                self.send_error(503)
                return
            if self.path == "/missing":
                self.send_error(404)
                return
            if self.path.startswith("/list"):
                page = int(self.path.rpartition("=")[2]) if "=" in self.path else 0
                body = json.dumps([{"path": f"f{page}{i}", "size": i} for i in range(2)]).encode()
                self.send_response(200)
                if page < 2:
                    self.send_header("Link", f'</list?page={page + 1}>; rel="next"')
            elif "Range" in self.headers:
                a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                body = data[a : b + 1]
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {a}-{a + len(body) - 1}/{len(data)}")
            else:
                body = b"whole"
                self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    served = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_port}"
    served.shutdown()


def test_requests_retry_and_give_up(server):
    assert remote.get(f"{server}/flaky")[0] == b"whole"
    with pytest.raises(OSError):
        remote.get(f"{server}/missing")
    with pytest.raises(OSError):
        remote.get(f"{server}/whole", retries=1, length=99)


def test_a_session_keeps_its_connection_and_header(server):
    session = remote.Session(server, token="abc")
    seen.clear()
    assert session.get("/one")[0] == b"whole" and session.get("/two")[0] == b"whole"
    assert len({who for who, _ in seen}) == 1 and {auth for _, auth in seen} == {"Bearer abc"}
    other = threading.Thread(target=session.get, args=("/three",))
    other.start()
    other.join()
    assert len({who for who, _ in seen}) == 2
    with pytest.raises(OSError):
        session.get("/missing")
    seen.clear()
    remote.Session(server).get("/four")
    assert seen[0][1] is None


def test_paged_listing(spark, server):
    spark.dataSource.register(remote.ListingSource)
    got = spark.read.format("paged_listing").option("urls", f"{server}/list").load()
    assert sorted(r["path"] for r in got.collect()) == ["f00", "f01", "f10", "f11", "f20", "f21"]


def test_members_are_read_by_range(server):
    with zipfile.ZipFile(io.BufferedReader(remote.RangeFile(f"{server}/zip"), 4096)) as z:
        assert z.read("a.txt") == b"hello" and len(z.read("b.txt")) == 100_000


def test_external_operators_say_what_they_lack():
    for name, lack in NEEDS.items():
        with pytest.raises(Unavailable, match=name) as said:
            external(name)()
        assert lack in str(said.value)


def test_dataset_root_layouts(spark, tmp_path):
    for tail in ("one", "datasets/me/two", "datasets/three", "deep/four"):
        (tmp_path / tail).mkdir(parents=True)
    root = str(tmp_path)
    for name, tail in (("one", "one"), ("two", "datasets/me/two"), ("three", "datasets/three"), ("four", "deep/four"), ("five", None)):
        found = catalogue.dataset_root(spark, root, "me", name)
        assert found == (f"{root}/{tail}" if tail else None)


def test_crops_have_structure(spark):
    from siltworks.operators.arrays import accept_crops

    df = spark.createDataFrame([(1, [float(i % 7) for i in range(64)]), (2, [1.0] * 64)], "k long, v array<double>")
    got = accept_crops(df, "k", "v", 8, 4, 2, 0.5, 3).collect()
    assert {r["k"] for r in got} == {1} and 0 < len(got) <= 2 and all(r["std"] >= 0.5 for r in got)
