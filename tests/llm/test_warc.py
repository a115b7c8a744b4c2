"""Archives written and read back, with records inside payloads, over many splits."""

import base64
import gzip
import hashlib
import random

import pytest

from scriptorium.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-row:99:AAAA>\r\nContent-Length: 7\r\n\r\n1234567\r\n\r\n"
B32 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def pages():
    rng = random.Random(4)
    bodies = [None, "", "a", FAKE, FAKE * 30, "x\r\n\r\n" + FAKE[:60], "é中🙂" * 40, "WARC/1." * 90, FAKE + "y" * 700 + FAKE, "twice", "twice", "\r\n\r\n", "z" * 5000]
    bodies += ["".join(rng.choice([FAKE, "w", "\r\n", "WARC/1.1\r\n", "WARC/1.", "t" * 50]) for _ in range(rng.randrange(40))) for _ in range(60)]
    return [(i, f"http://h/{i}\r\nWARC-Type: evil" if i % 7 == 0 else None if i % 5 == 0 else f"http://h/{i}", b) for i, b in enumerate(bodies)]


def brute(rows):
    last = {}
    for i, _, b in rows:
        b = (b or "").encode()
        last[b] = max(last.get(b, -1), -1 if i is None else i)
    out = []
    for i, _, b in rows:
        b = (b or "").encode()
        first = last[b] in (i, -1)
        out.append((i, len(b), B32(b), "response" if first else "revisit", None if first else last[b]))
    return sorted(out, key=repr)


def back(spark, path):
    got = warc.resolved(warc.read_warc(spark, path))
    return sorted(((r.row_id and int(r.row_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got.collect()), key=repr)


def test_round_trip_over_splits(spark, tmp_path, small_splits):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, f"{tmp_path}/a")
    assert back(spark, f"{tmp_path}/a") == brute(rows)
    got = {r.record_id: r for r in warc.read_warc(spark, f"{tmp_path}/a").collect()}
    assert len(got) == len(rows)
    for i, url, body in rows:
        body = (body or "").encode()
        r = got[f"<urn:x-row:{i}:{B32(body)}>"]
        assert r.record_type == "revisit" or bytes(r.payload) == body
        assert r.target_uri == (url and url.replace("\r", "%0D").replace("\n", "%0A"))


def test_ties_nulls_and_hot_groups(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "same") for i in range(40)] + [(None, None, "same"), (None, None, "alone"), (39, "u", "same"), (50, "u", "b"), (51, "u", "b"), (7, None, None), (8, None, "")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, record_type string, _hot int")
    warc.write_warc(df, f"{tmp_path}/a")
    assert back(spark, f"{tmp_path}/a") == brute(rows)
    monkeypatch.setattr(warc, "HOT_SHARE", 2)
    warc.write_warc(df, f"{tmp_path}/b")
    assert back(spark, f"{tmp_path}/b") == brute(rows)
    marked = warc.with_revisits(df, "page_id", "html", least_bytes=2)
    assert marked.where("record_type = 'revisit'").count() == 40
    warc.write_warc(df.limit(0), f"{tmp_path}/c")
    assert back(spark, f"{tmp_path}/c") == []


def record(body: bytes, kind="resource", more=b"") -> bytes:
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Record-ID: <urn:r>\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


@pytest.mark.parametrize("few", [True, False])
def test_foreign_and_broken_files(spark, tmp_path, small_splits, monkeypatch, few):
    monkeypatch.setattr(warc, "SENT_SPLITS", 1000 if few else 0)
    good, odd = record(b"one"), record(bytes(range(256)) * 4, "response", b"Content-Type: text/plain\r\nX: a:b\r\n")
    files = {
        "whole": good + odd + record(FAKE.encode() * 9) + good,
        "short": good * 20 + record(b"q" * 900)[:-300],
        "gap": good * 3 + b"junk" + good * 30,
        "late": b"\n" + good,
        "none": b"",
        "text": b"no records at all " * 40,
    }
    (tmp_path / "w").mkdir()
    for name, data in files.items():
        (tmp_path / "w" / name).write_bytes(data)
    (tmp_path / "w" / "packed.gz").write_bytes(gzip.compress(good) + gzip.compress(odd))
    got = {}
    for r in sorted(warc.read_warc(spark, f"{tmp_path}/w").collect(), key=lambda r: (r.file, r.offset)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(bytes(r.payload))
    assert got == {"whole": [b"one", bytes(range(256)) * 4, FAKE.encode() * 9, b"one"], "short": [b"one"] * 20, "gap": [b"one"] * 3, "packed.gz": [b"one", bytes(range(256)) * 4]}
