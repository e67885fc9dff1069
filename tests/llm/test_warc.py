import gzip
import hashlib
import random

import pytest

from glyphmill.llm import warc
from glyphmill.llm.common import scratch_dir
from glyphmill.llm.warc import MAGIC, archive, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, digest string, refers_to int"


def pages(spark):
    r = random.Random(8)
    big = "é" * 60
    rows = [(5, "http://a/\n b%20", big, "x", 1), (2, None, big, "x", 1), (9, "u", big, "x", 1), (1, "u", None, "x", 1), (3, "u", "", "x", 1), (4, "u", "short", "x", 1), (6, "u", "short", "x", 1)]
    rows += [(100 + i, f"http://h/{i}", "".join(chr(r.randrange(32, 1000)) for _ in range(r.randrange(3000))), "x", 1) for i in range(60)]
    rows += [(300 + i, "v", "\x1f\x8b\x08\x00 WARC/1.1\r\n\r\n" * 20 + str(i % 3), "x", 1) for i in range(9)]
    rows += [(400, "long", "abc" * 400_000, "x", 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows):
    first = {}
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        if len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    out = set()
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        refers = first[p] if len(p) >= 100 and first[p] != i else None
        out.add((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def test_round_trip_for_any_split(spark):
    rows, frame = pages(spark)
    path = scratch_dir(spark)
    write_archives(frame, path)
    for split in (700, 40_000, 4 << 20):
        got = read_archives(spark, path, split).collect()
        assert len(got) == len(rows) and {tuple(x)[:5] for x in got} == brute(rows)
        text = {i: (u, (h or "").encode()) for i, u, h, *_ in rows}
        assert all(x.url == text[x.page_id][0] for x in got)
        assert all(bytes(x.payload) == text[x.page_id][1] for x in got if x.record_type == "response")
    assert archive(frame.limit(0)).collect() == []


def test_false_magic_is_passed_over(spark, tmp_path):
    rows, frame = pages(spark)
    write_archives(frame.where("page_id < 7").coalesce(1), f"file://{tmp_path}")
    file = next(tmp_path.glob("*.warc.gz"))
    file.write_bytes(MAGIC + b"noise" + gzip.compress(b"no record") + file.read_bytes() + MAGIC)
    assert len(read_archives(spark, f"file://{tmp_path}").collect()) == sum(x[0] < 7 for x in rows)


def test_header_of_any_length(spark):
    rows = [(1, " " * 400_000, "y" * 200, "x", 1), (2, "data:," + "".join(chr(33 + i * i % 90) for i in range(3_000_000)), "y" * 200, "x", 1), (3, "u", "y" * 200, "x", 1)]
    got = archive(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(x)[:5] for x in got} == brute(rows) and len(got) == 3
    assert {x.page_id: x.url for x in got} == {i: u for i, u, *_ in rows}


def test_lost_records_are_an_error(spark, monkeypatch):
    frame = pages(spark)[1]
    read = read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: read(*a).where("page_id <> 5"))
    with pytest.raises(RuntimeError):
        archive(frame)


def test_pages_without_an_id(spark):
    shared, own = "z" * 150, "w" * 150
    rows = [(None, "a", shared, "x", 1), (None, "b", shared, "x", 1), (7, "c", shared, "x", 1), (8, "d", shared, "x", 1), (None, "e", own, "x", 1), (None, "f", own, "x", 1), (None, None, "short", "x", 1), (9, "g", "short", "x", 1), (None, "h", None, "x", 1)]
    got = archive(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len(t or ""), sha(t), *(("revisit", 7) if t == shared and i != 7 else ("response", None)), u) for i, u, t, *_ in rows]
    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted(want, key=str)
    assert all(bytes(x.payload) == ({u: t for _, u, t, *_ in rows}[x.url] or "").encode() for x in got if x.record_type == "response")


def test_files_of_other_attempts_are_not_read(spark, tmp_path, monkeypatch):
    """A task that failed after its rename has left a whole archive: the manifest does not name it."""
    rows, frame = pages(spark)
    path = f"file://{tmp_path}"
    manifest = write_archives(frame, path)
    first = next(tmp_path.glob("*.warc.gz"))
    (tmp_path / "part-again.warc.gz").write_bytes(first.read_bytes())
    (tmp_path / "part-half.warc.gz.part").write_bytes(first.read_bytes()[:500])
    got = read_archives(spark, manifest)
    assert len(got.collect()) == len(rows) and {tuple(x)[:5] for x in got.collect()} == brute(rows)
    assert read_archives(spark, path).count() > len(rows)
    monkeypatch.setattr(warc, "scratch_dir", lambda _: f"{path}/x")
    assert {tuple(x)[:5] for x in archive(frame).collect()} == brute(rows)


def test_ranges_are_read_by_many_tasks(spark):
    frame = pages(spark)[1]
    manifest = write_archives(frame, scratch_dir(spark))
    ranges = sum(-(-x.length // 40_000) for x in manifest.collect())
    assert read_archives(spark, manifest, 40_000).rdd.getNumPartitions() == ranges > 3


def test_repeated_rows(spark):
    rows = [(3, "u", "q" * 200, "x", 1), (3, "u", "q" * 200, "x", 1), (4, "u", "q" * 200, "x", 1), (4, "u", "q" * 200, "x", 1)]
    got = archive(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.page_id, x.record_type, x.refers_to or 0) for x in got) == [(3, "response", 0)] * 2 + [(4, "revisit", 3)] * 2
