import base64
import gzip
import hashlib
import os
import uuid

import pytest

from quantloom.llm import hot
from quantloom.llm.warc import parse_records, read_archive, restore, write_archive
from quantloom.session import checkpoint_root

SCHEMA = "page_id bigint, url string, html string, payload string"


def _digest(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _expected(rows):
    """Brute force: per page, bytes, digest, type and the page a revisit refers to."""
    groups: dict[bytes, list[int]] = {}
    for i, (pid, _, html, *_) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, members in groups.items():
        top = max(members, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, -i))
        for i in members:
            kind = "response" if i == top else "revisit"
            out.append((rows[i][0], len(payload), _digest(payload), kind, None if i == top else rows[top][0]))
    return sorted(out, key=repr)


def _run(spark, rows):
    path = f"{checkpoint_root(spark)}/test-warc-{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, SCHEMA)
    headers = write_archive(pages, path)
    got = restore(read_archive(spark, path), headers).selectExpr(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    return sorted((tuple(r) for r in got.collect()), key=repr), path, headers


ROWS = [
    (1, "http://a/1", "<p>same</p>", "x"),
    (5, "http://a/5", "<p>same</p>", "x"),
    (3, "http://a/3", "<p>same</p>", None),
    (2, None, None, None),  # null html: empty payload
    (4, "http://a/4", "", None),  # empty equals null
    (None, "http://a/n", "<p>same</p>", None),  # null id ranks lowest
    (6, "http://a/6", "body\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nend", None),
    (7, "http://a/7", "é" * 10_000 + "\u0000\r\n", None),
    (7, "http://a/7", "é" * 10_000 + "\u0000\r\n", None),  # a repeated row revisits its twin
]


def test_round_trip_against_brute_force(spark):
    got, _, _ = _run(spark, ROWS)
    assert got == _expected(ROWS)


def test_files_are_warc_and_payloads_stored_once(spark):
    _, path, headers = _run(spark, ROWS)
    records = []
    for name in os.listdir(path):
        if name.startswith("part-"):
            with open(os.path.join(path, name), "rb") as f:
                data = gzip.decompress(f.read())
            assert data.startswith(b"WARC/1.0\r\n")
            records += list(parse_records(data))
    assert len(records) == len(ROWS)
    stored = [r[4] for r in records if r[1] == "response"]
    assert len(stored) == len(set(stored)) == 4  # one response per distinct payload
    heads = {r.record_id: r.head for r in headers.collect()}
    assert all(heads[r[0]] == r[3] for r in records)
    revisit = next(r for r in records if r[1] == "revisit")
    assert "WARC-Refers-To: <urn:uuid:" in revisit[3] and revisit[4] is None


def test_hot_payload_is_salted(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_ROWS", 3)
    rows = [(i, f"u{i}", "hot" if i % 4 else f"cold {i}", None) for i in range(40)]
    got, _, _ = _run(spark, rows)
    assert got == _expected(rows)


def test_empty_table(spark):
    got, _, _ = _run(spark, [])
    assert got == []


def test_unequal_bytes_under_one_digest_fail(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quantloom.llm import warc

    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "page_id bigint, url string, html string")
    path = f"{checkpoint_root(spark)}/test-warc-{uuid.uuid4().hex}"
    real = F.sha2
    monkeypatch.setattr(warc.F, "sha2", lambda c, n: F.lit("one address"))  # both payloads filed as one
    headers = write_archive(pages, path)
    monkeypatch.setattr(warc.F, "sha2", real)
    with pytest.raises(Exception, match="SHA-1"):
        restore(read_archive(spark, path), headers).collect()
