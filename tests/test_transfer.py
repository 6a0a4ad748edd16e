"""Copies in ranges: over HTTP, broken off and gone on with, verified, and from one file system to another."""

import hashlib
import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from cohortloom.sources import transfer
from cohortloom.sources.dimension import retrieve, stage_dimension
from cohortloom.sources.stage import retrieval_log
from cohortloom.sources.tables import file_dims, footer_count
from cohortloom.sources.transfer import Copy, copy_files, ranges

BODY = os.urandom(1 << 20) + b"tail"


class Mirror(ThreadingHTTPServer):
    """Serves ``files``; requests that begin at one of ``broken`` end in the middle."""

    def __init__(self):
        self.files, self.broken, self.asked, self.ranged, self.tag = {"/f": BODY, "/empty": b""}, set(), [], True, "a"
        super().__init__(("127.0.0.1", 0), Handler)
        self.root = f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def head(self, body, status, size):
        self.send_response(status)
        self.send_header("Content-Length", str(size))
        self.send_header("ETag", self.server.tag)
        if self.server.ranged:
            self.send_header("Accept-Ranges", "bytes")
        self.end_headers()

    def do_HEAD(self):
        body = self.server.files.get(self.path)
        if body is None:
            self.send_error(404)
        else:
            self.head(body, 200, len(body))

    def do_GET(self):
        body, first, status = self.server.files.get(self.path), 0, 200
        if body is None:
            return self.send_error(404)
        if self.server.ranged and (m := re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))):
            first, status = int(m[1]), 206
            body = body[first : int(m[2]) + 1]
        self.server.asked.append(first)
        self.head(body, status, len(body))
        self.wfile.write(body[: len(body) // 2] if first in self.server.broken else body)


@pytest.fixture
def mirror():
    s = Mirror()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def copied(spark, source, target, **options):
    (got,) = copy_files(spark, [Copy(source, str(target), options.pop("bytes", None), options.pop("sha256", None))], **{"retry_max": 1, "backoff": 0, "range_bytes": 1 << 18, **options})
    return got


def test_broken_copy_goes_on_where_it_stopped(spark, mirror, tmp_path):
    at = tmp_path / "deep" / "f"
    mirror.broken = {2 << 18}
    got = copied(spark, f"{mirror.root}/f", at)
    assert got[0] == "failed" and "incomplete" in got[5] and not at.exists()
    assert sorted(mirror.asked) == [k << 18 for k in range(5)]
    mirror.broken, mirror.asked = set(), []
    got = copied(spark, f"{mirror.root}/f", at, bytes=len(BODY), sha256=hashlib.sha256(BODY).hexdigest().upper())
    assert got[0] == "downloaded" and got[2] == len(BODY) and got[3] == hashlib.sha256(BODY).hexdigest()
    assert mirror.asked == [2 << 18] and at.read_bytes() == BODY and os.listdir(at.parent) == ["f"]
    mirror.asked = []
    assert copied(spark, f"{mirror.root}/f", at, sha256=hashlib.sha256(BODY).hexdigest())[0] == "reused" and mirror.asked == []


def test_ranges_of_another_version_are_not_mixed(spark, mirror, tmp_path):
    mirror.broken = {1 << 18}
    assert copied(spark, f"{mirror.root}/f", tmp_path / "f")[0] == "failed"
    mirror.files["/f"], mirror.tag, mirror.broken = BODY[::-1], "b", set()
    assert copied(spark, f"{mirror.root}/f", tmp_path / "f")[0] == "downloaded" and (tmp_path / "f").read_bytes() == BODY[::-1]


def test_retries_count_for_a_range(spark, mirror, tmp_path):
    mirror.broken = {0}
    got = copied(spark, f"{mirror.root}/f", tmp_path / "f", retry_max=3)
    assert got[0] == "failed" and got[1] == 3 and mirror.asked.count(0) == 3
    with pytest.raises(ValueError):
        copied(spark, f"{mirror.root}/f", tmp_path / "f", retry_max=0)


def test_servers_without_ranges_and_odd_files(spark, mirror, tmp_path):
    mirror.ranged = False
    assert copied(spark, f"{mirror.root}/f", tmp_path / "f")[0] == "downloaded" and (tmp_path / "f").read_bytes() == BODY
    assert mirror.asked == [0]
    mirror.broken = {0}
    assert copied(spark, f"{mirror.root}/f", tmp_path / "g")[0] == "failed" and not (tmp_path / "g").exists()
    mirror.broken, mirror.ranged = set(), True
    assert copied(spark, f"{mirror.root}/empty", tmp_path / "e")[:3] == ("downloaded", 1, 0) and (tmp_path / "e").read_bytes() == b""
    assert copied(spark, f"{mirror.root}/none", tmp_path / "n")[0] == "failed"
    assert copied(spark, "http://127.0.0.1:9/f", tmp_path / "n")[0] == "failed"
    assert copy_files(spark, []) == []


def test_what_is_not_as_published_goes(spark, mirror, tmp_path):
    at = tmp_path / "f"
    for wrong in ({"sha256": "0" * 64}, {"bytes": 7}):
        got = copied(spark, f"{mirror.root}/f", at, **wrong)
        assert got[0] == "failed" and "expected" in got[5] and os.listdir(tmp_path) == []
    at.write_bytes(b"old")
    assert copied(spark, f"{mirror.root}/f", at)[0] == "reused"
    assert copied(spark, f"{mirror.root}/f", at, sha256=hashlib.sha256(BODY).hexdigest())[0] == "downloaded" and at.read_bytes() == BODY
    at.write_bytes(b"old")
    assert copied(spark, f"{mirror.root}/f", at, overwrite=True)[0] == "downloaded" and at.read_bytes() == BODY


def test_tasks_that_run_again(tmp_path):
    """A lost executor's tasks run once more: after the ranges are there, and after the file was committed."""
    (tmp_path / "a.gz").write_bytes(BODY)
    at, version = str(tmp_path / "b.gz"), transfer.probe(str(tmp_path / "a.gz"), 1)[2]
    sizes = [(0, 1 << 19), (1 << 19, len(BODY) - (1 << 19))]
    runs = [[transfer.fetch_range(str(tmp_path / "a.gz"), at, version, first, n, 1, 1, 0) for first, n in sizes] for _ in range(2)]
    assert [r[:2] for r in runs[0]] == [r[:2] for r in runs[1]] and [r[2] for r in runs[1]] == [0, 0]
    parts = [(first, n, digest) for (first, n), (_, digest, _) in zip(sizes, runs[0])]
    once = transfer.commit(Copy("", at), version, parts)
    assert transfer.commit(Copy("", at), version, parts) == once == (len(BODY), hashlib.sha256(BODY).hexdigest())
    os.remove(at)
    with pytest.raises(OSError, match="gone"):
        transfer.commit(Copy("", at), version, parts)


def test_any_file_system(monkeypatch, tmp_path):
    """Sources and targets by URI, where a rename doesn't replace what is there."""
    from pyarrow import fs

    monkeypatch.setattr(transfer, "_system", lambda scheme, authority: fs.SubTreeFileSystem(str(tmp_path / scheme / authority), fs.LocalFileSystem()))
    (tmp_path / "hdfs" / "n1").mkdir(parents=True)
    (tmp_path / "hdfs" / "n1" / "a").write_bytes(BODY)
    (tmp_path / "far" / "n2").mkdir(parents=True)
    size, ranged, version = transfer.probe("hdfs://n1/a", 1)
    assert (size, ranged) == (len(BODY), True)
    for parts in ([(0, len(BODY))], [(0, 9), (9, len(BODY) - 9)]):
        done = [(first, n, transfer.fetch_range("hdfs://n1/a", "far://n2/x/b", version, first, n, 1, 1, 0)[1]) for first, n in parts]
        transfer.commit(Copy("hdfs://n1/a", "far://n2/x/b"), version, done)
        assert (tmp_path / "far" / "n2" / "x" / "b").read_bytes() == BODY and transfer.size_there("far://n2/x/b") == len(BODY)
    assert os.listdir(tmp_path / "far" / "n2" / "x") == ["b"]


def test_range_rows(spark):
    files = spark.createDataFrame([(0, "a", "b", None, None, 25, True, "", None, False, None), (1, "a", "b", None, None, 25, False, "", None, False, None), (2, "a", "b", None, None, None, False, "", None, False, None),
                                   (3, "a", "b", None, None, 0, True, "", None, False, None), (4, "a", "b", None, None, 20, True, "", None, False, None)], transfer.PROBED)
    got = sorted((r.i, r.first, r.length) for r in ranges(files, 10).select("i", "first", "length").collect() if r.i not in (1, 2, 3))
    assert got == [(0, 0, 10), (0, 10, 10), (0, 20, 5), (4, 0, 10), (4, 10, 10)]
    assert sorted((r.i, r["first"], r.length) for r in ranges(files, 10).where("i in (1, 2, 3)").collect()) == [(1, 0, None), (2, 0, None), (3, 0, None)]


def test_dimension_is_staged_where_a_path_is_given(spark, tmp_path):
    root, cache = tmp_path / "build", str(tmp_path / "cache")
    root.mkdir()
    body = b"EIN2,org_name_display\nein-1,one\n"
    (root / "bmf_unified_geocoded.csv").write_bytes(body)
    (root / "_manifest.json").write_text('{"files": [{"name": "bmf_unified_geocoded.csv", "bytes": %d, "sha256": "%s"}]}' % (len(body), hashlib.sha256(body).hexdigest()))
    want = [("EIN-1", "one")]
    for _ in range(2):
        assert [tuple(r) for r in retrieve(spark, str(root), ("EIN2", "org_name_display"), path=cache).df.collect()] == want
    assert [(r.kind, r.downloaded, r.reused) for r in retrieval_log(spark, cache).collect()] == [("dimension", 1, 0), ("dimension", 0, 1)]
    (root / "bmf_unified_geocoded.csv").write_bytes(body.replace(b"one", b"two"))
    assert stage_dimension(spark, str(root), cache, "csv", overwrite=True, retry_max=1).status == "failed"
    with pytest.raises(OSError, match="SHA-256"):
        retrieve(spark, str(root), ("EIN2", "org_name_display"), path=cache, overwrite=True)


def test_dims_come_from_footers(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    spark.range(1000).selectExpr("id", "id * 2 AS b", "cast(id as string) AS c").repartition(3).write.parquet(at)
    spark.range(7).selectExpr("id", "'x' AS b").write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert file_dims(spark, at) == (1000, 3) and file_dims(spark, str(tmp_path / "t.csv")) == (7, 2)
    plan = footer_count(spark, at)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
