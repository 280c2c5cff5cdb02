"""Policy gates: rates against thresholds."""

from __future__ import annotations


def rule(metric: str, threshold: float, actual: float) -> dict:
    """Rates are upper bounds: a rule passes at its threshold."""
    return {"metric": metric, "threshold": threshold, "actual": actual, "passed": actual <= threshold}


def combine(rules: list[dict]) -> dict | None:
    return {"passed": all(r["passed"] for r in rules), "rules": rules} if rules else None


def overlap_threshold(fail_on_overlap: bool = False, max_overlap_rate: float | None = None) -> float | None:
    """The stricter of the two demands; None without any."""
    demands = [0.0] * fail_on_overlap + ([max_overlap_rate] if max_overlap_rate is not None else [])
    return min(demands, default=None)


def compare_gate(report: dict, fail_on_overlap: bool = False, max_overlap_rate: float | None = None) -> dict | None:
    t = overlap_threshold(fail_on_overlap, max_overlap_rate)
    return None if t is None else combine([rule(f"{kind}_rate", t, report["result"][kind]["rate"]) for kind in ("exact_overlap", "normalized_overlap")])


def benchmark_gate(report: dict, fail_on_overlap: bool = False, max_overlap_rate: float | None = None) -> dict | None:
    t = overlap_threshold(fail_on_overlap, max_overlap_rate)
    return None if t is None else combine([rule(f"{kind}_match_rate", t, report["result"][f"{kind}_rate"]) for kind in ("exact", "normalized")])


def scan_gate(report: dict, max_duplicate_rate: float | None = None, max_near_duplicate_rate: float | None = None) -> dict | None:
    rules = []
    if max_duplicate_rate is not None:
        rules.append(rule("duplicate_rate", max_duplicate_rate, report["result"]["exact_duplicates"]["duplicate_rate"]))
    if max_near_duplicate_rate is not None:
        if not report["configuration"]["near_duplicates"]["enabled"]:
            raise ValueError("a near-duplicate rate can be gated only if near-duplicates are analysed: leave out --skip-near-duplicates")
        rules.append(rule("near_duplicate_rate", max_near_duplicate_rate, report["result"]["near_duplicates"]["record_rate"]))
    return combine(rules)
