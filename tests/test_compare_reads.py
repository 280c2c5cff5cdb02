"""Comparing reads each side once for all digests, and texts again only for pairs that it shows."""

import pytest

from sievework.plans import reports
from sievework.sources.datasets import ROW, Dataset


@pytest.mark.parametrize("field", [None, "text"])
def test_records_are_digested_once_a_side(spark, monkeypatch, field):
    a = spark.createDataFrame([(0, "x", "1"), (1, " y ", "2"), (2, None, "3")], f"{ROW} long, text string, other string")
    b = spark.createDataFrame([(0, "y", "2"), (1, "x", "1"), (2, None, "4")], f"{ROW} long, text string, other string")
    calls, real = [], reports.record_digest
    monkeypatch.setattr(reports, "record_digest", lambda df, strip, columns=None: calls.append(strip) or real(df, strip, columns))
    r = reports.compare(*(Dataset(d, "frame", "(frame)", ["text", "other"], 0) for d in (a, b)), 100, field)
    assert sum(calls) == 2  # normalised ones, for overlaps and fingerprints alike
    assert r["result"]["exact_overlap"]["shared_records"] == 1 and r["result"]["normalized_overlap"]["shared_records"] == 2
    shown = [m for m in r["result"]["matches"]["normalized"] if not m["also_exact"]]
    assert [(m["dataset_a_record"], m["dataset_b_record"]) for m in shown] == [(1, 0)]
    assert shown[0].get("difference") == (None if field is None else {"a": " y ", "b": "y"})
    assert r["input"]["dataset_a"]["rows"] == r["input"]["dataset_b"]["rows"] == 3 and r["input"]["dataset_a"]["fingerprint"] != r["input"]["dataset_b"]["fingerprint"]
