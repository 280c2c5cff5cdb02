import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sievework.llm import warc
from sievework.session import shared_dir

PAGES = "page_id long, url string, html string, digest string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], PAGES)


ROWS = [(i, f"http://x/{i}", "<p>" + "copy " * 40 if i % 3 == 0 else f"<p>own page {i}</p>" * 9) for i in range(1, 60)]
ROWS += [(100, None, None), (101, "u", ""), (102, "u\r\nInjected: yes é", "short"), (103, "v", "short"), (104, "w", "é\x00\r\n\r\nWARC/1.1" * 30), (105, "long", "x" * 3_000_000), (None, "n", "<p>" + "copy " * 40), (7, "again", "<p>own page 7</p>" * 9)]


def test_round_trip(spark):
    index = warc.write(pages(spark, ROWS), file_bytes=4000)
    got = warc.read(index, shared_dir(spark)).collect()
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h or ""] != i
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(expected, key=str)
    assert all(bytes(r["payload"]) == next((h or "").encode() for i, _, h in ROWS if i == r["page_id"]) for r in got if r["payload"] is not None and r["page_id"] != 7)
    assert {r["file"] for r in index.select("file").distinct().collect()} and index.count() == len(ROWS)


def test_selected_records_only(spark):
    index = warc.write(pages(spark, ROWS))
    assert {r["page_id"] for r in warc.read(index.where(F.col("page_id").isin(4, 105, 102)), shared_dir(spark)).collect()} == {4, 105, 102}
    assert warc.read(index.where("false"), shared_dir(spark)).count() == 0
    assert warc.read(warc.write(pages(spark, [])), shared_dir(spark)).count() == 0


def test_archives_are_plain_gzip_members(spark):
    index = warc.write(pages(spark, ROWS[:5]))
    r = index.where("page_id = 2").first()
    with open(r["file"], "rb") as f:
        f.seek(r["offset"])
        raw = gzip.decompress(f.read(r["length"]))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
    parsed = warc.parse(raw)
    assert parsed["payload"] == ROWS[1][2].encode() and parsed["headers"]["WARC-Target-URI"] == "http://x/2"


def test_damage_is_noticed(spark):
    index = warc.write(pages(spark, [(1, "u", "hello"), (2, "u", "other")]))
    moved = index.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception):
        warc.read(moved, shared_dir(spark)).collect()


def test_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP, 5), ("a", 10_000_000, 5), ("b", 0, 1)]
    assert [(f, s, e, len(r)) for f, s, e, r in warc._ranges(rows)] == [("a", 0, 25 + warc.GAP, 3), ("a", 10_000_000, 10_000_005, 1), ("b", 0, 1, 1)]
