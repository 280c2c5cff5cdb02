import hashlib
import json
import random
from itertools import combinations
from pathlib import Path

import pytest

from sievework import cli
from sievework.operators import gates, neardup
from sievework.operators.duplicates import TREE_PREFIX, fingerprint, tree_fingerprint, with_digest
from sievework.operators.neardup import NearDuplicateConfig
from sievework.operators.overlap import match_rate, overlap_rate
from sievework.plans import model, reports, terminal


def jsonl(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return path


def digest(record, strip=True):
    record = {k: v.strip() if strip and isinstance(v, str) else v for k, v in record.items()}
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def near_method(report):
    return report["method"]["near_duplicates"]


def found(report, kind):
    return report["result"][f"{kind}_overlap"]


@pytest.fixture
def five(tmp_path):
    rows = [("one text", "made"), ("one text", "made"), ("two", "web"), ("  one text  ", "made"), ("three", "own")]
    return jsonl(tmp_path / "five.jsonl", [{"text": t, "source": s} for t, s in rows])


@pytest.fixture
def pair(tmp_path):
    a = [("both exactly", "t"), ("a only", "t"), ("  both when stripped  ", "t"), ("a too", "t")]
    b = [("both exactly", "t"), ("b only", "e"), ("both when stripped", "t"), ("b too", "e")]
    return tuple(jsonl(tmp_path / f"{n}.jsonl", [{"text": t, "source": s} for t, s in rows]) for n, rows in (("a", a), ("b", b)))


def test_scan(spark, five):
    r = reports.scan_dataset(spark, five)
    assert r["result"]["exact_duplicates"] == {"total_records": 5, "unique_records": 3, "duplicate_records": 2, "duplicate_rate": 0.4}
    records = [json.loads(line) for line in five.read_text().splitlines()]
    expected = hashlib.sha256("".join(h + "\n" for h in sorted(map(digest, records))).encode()).hexdigest()[:16]
    assert r["result"]["fingerprint"] == f"sieve:{expected}"
    assert r["input"]["columns"] == ["text", "source"] and near_method(r)["candidate_generation"] == "pairwise"
    assert "gate" not in r and "sieve" in terminal.scan_text(r, "x")


def test_fingerprints_ignore_order(spark):
    rows = [("a", 1), ("b", 2), ("b", 2)]
    one, two = (spark.createDataFrame(x, "text string, n int") for x in (rows, rows[::-1]))
    for f in (fingerprint, tree_fingerprint):
        assert f(with_digest(one)) == f(with_digest(two)) != f(with_digest(one.limit(2)))
    assert fingerprint(with_digest(one.limit(0)), "") == "2e1cfa82b035c26c"


def test_compare_records(spark, pair):
    r = reports.compare_datasets(spark, *pair)
    assert found(r, "exact") == {"shared_records": 1, "only_in_a": 3, "only_in_b": 3, "rate": 0.25}
    assert found(r, "normalized")["shared_records"] == 2
    m = r["result"]["matches"]
    assert m["exact"] == [{"dataset_a_record": 0, "dataset_b_record": 0}]
    assert m["normalized"][0] == {"dataset_a_record": 0, "dataset_b_record": 0, "also_exact": True}
    assert m["normalized"][1]["differing_fields"] == [{"field": "text", "a": "  both when stripped  ", "b": "both when stripped"}]
    assert "text_exact" not in r["method"] and not r["method"]["record_exact"]["string_strip"]
    assert "both when stripped" in terminal.compare_text(r, "x")


def test_compare_a_field(spark, pair):
    r = reports.compare_datasets(spark, *pair, text_field="text")
    m = r["result"]["matches"]
    assert m["normalized"][1]["difference"] == {"a": "  both when stripped  ", "b": "both when stripped"} and m["normalized"][1]["field"] == "text"
    with pytest.raises(ValueError, match="Column 'none' not found"):
        reports.compare_datasets(spark, *pair, text_field="none")


def test_compare_with_itself_is_capped(spark, tmp_path):
    p = jsonl(tmp_path / "x.jsonl", [{"text": "same", "id": i} for i in range(5)])
    r = reports.compare_datasets(spark, p, p, max_evidence=2)
    assert found(r, "exact")["shared_records"] == 5 and len(r["result"]["matches"]["exact"]) == 2 and r["result"]["matches"]["exact_truncated"]
    r = reports.compare_datasets(spark, p, p, max_evidence=7, text_field="text")
    pairs = [(x["dataset_a_record"], x["dataset_b_record"]) for x in r["result"]["matches"]["exact"]]
    assert pairs == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1)] and r["result"]["matches"]["normalized_truncated"]


def test_benchmark_check(spark, tmp_path):
    ref = jsonl(tmp_path / "ref.jsonl", [{"question": "What is two plus two?"}, {"question": "Another one"}])
    data = jsonl(tmp_path / "d.jsonl", [{"question": "What is two plus two?", "text": "x"}, {"question": "  ", "prompt": " Another one "}, {"text": "neither"}, {"other": 1}])
    r = reports.check_benchmark(spark, data, "gsm8k", ref)
    assert (r["result"]["exact_matches"], r["result"]["normalized_matches"], r["result"]["status"]) == (1, 2, "OVERLAP_DETECTED")
    assert r["result"]["matches"]["normalized"] == [{"dataset_record": 0, "reference_record": 0, "field": "question"}, {"dataset_record": 1, "reference_record": 1, "field": "prompt"}]
    assert r["result"]["normalized_rate"] == 0.5 and r["input"]["reference_source"] == "user_reference" and "Another" not in terminal.benchmark_text(r, "x")
    assert reports.check_benchmark(spark, data, "gsm8k")["result"]["status"] == "NO_OVERLAP_DETECTED"


def brute_near(texts, digests, threshold, size=5):
    def grams(t):
        t = " ".join(t.lower().split())
        return {t} if 0 < len(t) < size else {t[i : i + size] for i in range(len(t) - size + 1)}

    sets, found = [grams(t) for t in texts], []
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        score = 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0
        if digests[i] != digests[j] and score >= threshold:
            found.append((i, j, round(score, 4)))
    return found


@pytest.mark.parametrize("n", [40, 300])
def test_near_duplicates_against_all_pairs(spark, tmp_path, n):
    base = "The quick brown fox jumps over the lazy dog while {} other animals look on from number {}"
    rows = [{"text": base.format(i % 7, i % 3) if i % 4 else ["", "  ", "solo", f"unlike {i} " * 9, None][i % 5], "id": i // 2} for i in range(n)]
    p = jsonl(tmp_path / "n.jsonl", rows)
    r = reports.scan_dataset(spark, p, NearDuplicateConfig(threshold=0.8, max_evidence=50))["result"]["near_duplicates"]
    texts = [(x["text"] or "").strip() for x in rows]
    expected = brute_near(texts, [digest(x) for x in rows], 0.8)
    flagged = {i for p_ in expected for i in p_[:2]}
    assert (r["pairs"], r["records_flagged"], r["record_rate"]) == (len(expected), len(flagged), round(len(flagged) / n, 6))
    assert [(e["left"], e["right"], e["jaccard"]) for e in r["evidence"]] == expected[:50] and r["evidence_truncated"]


def test_near_duplicate_fields_and_regimes(spark, tmp_path):
    p = jsonl(tmp_path / "f.jsonl", [{"body": "a shared body of text", "n": 1}, {"body": "A shared  body of text", "n": 2}])
    r = reports.scan_dataset(spark, p)
    assert r["result"]["near_duplicates"]["evidence"] == [{"left": 0, "right": 1, "jaccard": 1.0, "field": "body"}]
    p = jsonl(tmp_path / "num.jsonl", [{"n": i} for i in range(300)])
    r = reports.scan_dataset(spark, p)
    assert r["result"]["near_duplicates"]["pairs"] == 300 * 299 // 2 and near_method(r)["minhash"] == {"enabled": True, "num_perm": 64}
    r = reports.scan_dataset(spark, p, NearDuplicateConfig(enabled=False))
    assert near_method(r)["candidate_generation"] == "disabled"
    empty = tmp_path / "e.parquet"
    spark.createDataFrame([], "text string").coalesce(1).toPandas().to_parquet(empty)
    r = reports.scan_dataset(spark, empty)
    assert r["input"]["rows"] == 0 and near_method(r)["candidate_generation"] == "none"


def test_rates_and_gates():
    assert overlap_rate(1, 3, 1) == 0.5 and overlap_rate(0, 0, 5) == 0.0 and match_rate(1, 0) == 0.0
    assert gates.overlap_threshold(True, 0.5) == 0.0 and gates.overlap_threshold(False, 0.5) == 0.5 and gates.overlap_threshold() is None
    assert gates.rule("m", 0.5, 0.5)["passed"] and not gates.rule("m", 0.0, 0.1)["passed"]
    report = {"result": {"exact_duplicates": {"duplicate_rate": 0.4}}, "configuration": {"near_duplicates": {"enabled": False}}}
    assert gates.scan_gate(report) is None and not gates.scan_gate(report, max_duplicate_rate=0.1)["passed"]
    with pytest.raises(ValueError):
        gates.scan_gate(report, max_near_duplicate_rate=0.1)


def test_command_line(spark, five, pair, tmp_path, capsys):
    out = tmp_path / "o" / "r.json"
    into = ["-o", str(out)]
    assert cli.main(["scan", str(five), *into], spark) == 0 and json.loads(out.read_text())["input"]["rows"] == 5
    assert cli.main(["scan", str(five), *into, "--max-duplicate-rate", "0.1"], spark) == 2 and not json.loads(out.read_text())["gate"]["passed"]
    assert cli.main(["scan", str(tmp_path / "none.jsonl")], spark) == 1 and cli.main(["scan"], spark) == 1
    assert cli.main(["scan", str(five), "--max-near-duplicate-rate=0.1", "--skip-near-duplicates"], spark) == 1
    assert cli.main(["compare", *map(str, pair), *into, "--fail-on-overlap"], spark) == 2
    assert json.loads(out.read_text())["configuration"]["fail_on_overlap"] is True
    assert cli.main(["compare", *map(str, pair), *into, "--max-overlap-rate", "0.5"], spark) == 0
    assert cli.main(["benchmark-check", str(five), "-b", "unknown"], spark) == 1
    assert cli.main(["benchmark-check", str(five), "-b", "gsm8k", *into, "--fail-on-overlap"], spark) == 0
    assert cli.main([], spark) == 0
    capsys.readouterr()


def test_example_overlaps_the_packaged_sample(spark):
    report = reports.check_benchmark(spark, Path(__file__).parents[1] / "examples" / "train_with_overlap.jsonl", "gsm8k")
    assert report["result"]["exact_matches"] == 1 and report["result"]["normalized_matches"] == 2
    assert report["result"]["matches"]["normalized"] == [{"dataset_record": 0, "reference_record": 2, "field": "question"}, {"dataset_record": 1, "reference_record": 1, "field": "question"}]


def test_reports_are_checked_against_their_model(spark, five):
    report = reports.scan_dataset(spark, five, prefix=TREE_PREFIX)
    assert report["result"]["fingerprint"].startswith(TREE_PREFIX) and report["method"]["fingerprint"].endswith("_tree")
    gated = reports.with_gate(report, gates.scan_gate(report, max_duplicate_rate=0), max_duplicate_rate=0)
    assert model.check(gated, model.SCAN) is gated
    for change in ({"rows": 5.0}, {"rows": True}, {"more": 1}, {"columns": [1]}, {"columns": "text"}, {"path": None}):
        with pytest.raises(ValueError, match="report.input"):
            model.check({**report, "input": report["input"] | change}, model.SCAN)
    with pytest.raises(ValueError, match="too few: notes"):
        model.check({k: v for k, v in report.items() if k != "notes"}, model.SCAN)


@pytest.mark.parametrize("block", [4, 1000])
def test_hot_buckets_are_split_without_loss(spark, block):
    rng = random.Random(block)
    keys = {f"t{i}": [7 if i < 40 else rng.randrange(4), rng.randrange(30), rng.randrange(30)] for i in range(70)}
    pairs = [tuple(r) for r in neardup.candidates(spark.createDataFrame(list(keys.items()), "t string, keys array<long>"), block).collect()]
    assert sorted(pairs) == sorted((x, y) for x in keys for y in keys if x < y and any(a == b for a, b in zip(keys[x], keys[y])))
