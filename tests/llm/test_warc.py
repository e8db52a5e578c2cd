import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from tidemark.llm import queries, warc
from tidemark.llm.shared import Workspace

SCHEMA = "page_id long, url string, html string, sha string, kind int, refers_to long"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 5, 6) for i, u, h in rows], SCHEMA)


def brute(rows):
    key = lambda i: (i is None, i or 0)
    out, seen = [], {}
    for i, u, h in sorted(rows, key=lambda r: (key(r[0]), r[2] or "", r[1] is not None, r[1] or "")):
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = body not in seen
        seen.setdefault(body, i)
        out.append((i, len(body), digest, "response" if first else "revisit", None if first else seen[body]))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "http://c\r\nX: y", ""), (4, "http://d", "<p>x</p>"), (4, "http://d", "<p>x</p>"), (4, "http://e", "other"), (-9, "http://n", "ümlaut"), (None, "http://z", "<p>x</p>"), (None, None, "only null"), (2**62, "u", "ümlaut"), (7, "long", "z" * 300000), (8, "r", "\r\n\r\nWARC/1.1\r\n\r\n")]


def columns(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=str)


def test_round_trip(spark):
    assert columns(warc.archive_round_trip(frame(spark, ROWS))) == brute(ROWS)


def test_files_roll_are_deterministic_and_listed(spark):
    rows = [(k, f"http://h/{k}", f"body {k} " * 50) for k in range(200)]
    folders = [Workspace(spark, "test").folder("warc") for _ in range(2)]
    for f in folders:
        manifest = warc.write_archives(frame(spark, rows), f, roll=4000).collect()
    names = {r["name"] for r in manifest}
    here = [Path(f.removeprefix("file://")) for f in folders]
    assert {p.name for p in here[0].glob("part-*")} == names and len(names) > 4 and not list(here[0].glob("_temporary*"))
    assert all(r["bytes"] <= 4000 for r in manifest) and sum(r["records"] for r in manifest) == 200
    assert all((here[0] / n).read_bytes() == (here[1] / n).read_bytes() for n in names)
    pages = [r["page_id"] for n in sorted(names) for r in warc.parse((here[0] / n).read_bytes())]
    assert pages == sorted(pages) and len(pages) == 200
    (here[0] / "part-99999-00000.warc.gz").write_bytes(gzip.compress(b"left by a lost attempt"))
    assert warc.read_archives(spark, folders[0]).count() == 200


def test_ids_survive():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 2**62, None):
        assert warc.page_of(warc.record_id(i)) == i


def test_damage_is_found():
    data = bytearray(gzip.decompress(warc.record(1, "u", b"payload", warc.digest_of(b"payload"), None, False)))
    data[data.index(b"payload", 400)] ^= 1
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(gzip.compress(bytes(data))))


def test_empty_table(spark):
    assert warc.archive_round_trip(frame(spark, [])).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert columns(queries.op9_warc_writer(spark, sf)) == brute(rows)
