"""What reports consist of. ``check`` raises where a report has a key too many or too few, or a value of another type.

A model is a type, a list of one model, or a dictionary of models; keys that end in a question mark may be missing.
"""

from __future__ import annotations

from typing import Any

_SPEC = {
    "id": str, "base_normalization?": str, "includes_all_fields?": bool, "sort_object_keys?": bool, "string_strip": bool,
    "collapse_internal_whitespace": bool, "case_fold": bool, "serialization": str, "hash": str, "notes": [str],
}
_GATE = {"passed": bool, "rules": [{"metric": str, "threshold": float, "actual": float, "passed": bool}]}
_SHINGLE = {"unit": str, "size": int}
_DATASET = {"path": str, "format": str, "rows": int, "size_bytes": int, "columns": [str], "fingerprint": str}
_STATS = {"shared_records": int, "only_in_a": int, "only_in_b": int, "rate": float}
_DIFFERENCE = {"field": str, "a": object, "b": object}
_PAIR = {"dataset_a_record": int, "dataset_b_record": int, "field?": str}
_FOUND = {"dataset_record": int, "reference_record": int, "field": str}

_SHELL: dict[str, Any] = {"tool": str, "version": str, "contract": str, "disclaimer": str, "gate?": _GATE, "notes": [str]}

SCAN = _SHELL | {
    "input": {"path": str, "format": str, "rows": int, "size_bytes": int, "columns": [str]},
    "configuration": {
        "row_index_base": int, "max_duplicate_rate?": float, "max_near_duplicate_rate?": float,
        "near_duplicates": {"enabled": bool, "threshold": float, "shingle": _SHINGLE, "num_perm": int, "max_evidence_pairs": int},
    },
    "method": {
        "unit": str, "fingerprint": str, "exact_duplicates": str, "row_index_base": int, "record_normalized": _SPEC,
        "near_duplicates": {
            "similarity": str, "candidate_generation": str, "shingle": _SHINGLE, "minhash": {"enabled": bool, "num_perm?": int},
            "text_prep": {"id": str, "prefer_text_column": bool, "fallback": str, "lowercase": bool, "collapse_whitespace": bool, "notes": [str]},
        },
    },
    "result": {
        "fingerprint": str,
        "exact_duplicates": {"total_records": int, "unique_records": int, "duplicate_records": int, "duplicate_rate": float},
        "near_duplicates": {"pairs": int, "records_flagged": int, "record_rate": float, "evidence": [{"left": int, "right": int, "jaccard": float, "field?": str}], "evidence_truncated": bool},
    },
}

COMPARE = _SHELL | {
    "input": {"dataset_a": _DATASET, "dataset_b": _DATASET},
    "configuration": {"match_exact": bool, "match_normalized": bool, "max_evidence_pairs": int, "row_index_base": int, "field?": str, "fail_on_overlap": bool, "max_overlap_rate?": float},
    "method": {
        "unit": str, "field?": str, "exact_overlap": str, "normalized_overlap": str, "fingerprint": str, "row_index_base": int, "field_diff?": str,
        "record_exact?": _SPEC, "record_normalized?": _SPEC, "text_exact?": _SPEC, "text_normalized?": _SPEC,
    },
    "result": {
        "exact_overlap": _STATS, "normalized_overlap": _STATS,
        "matches": {
            "exact": [_PAIR], "normalized": [_PAIR | {"also_exact": bool, "differing_fields?": [_DIFFERENCE], "difference?": {"a": str, "b": str}}],
            "exact_truncated": bool, "normalized_truncated": bool,
        },
    },
}

BENCHMARK = _SHELL | {
    "input": {"dataset": _DATASET, "benchmark_id": str, "benchmark_name": str, "reference_source": str, "reference_path": str, "benchmark_records": int, "benchmark_fingerprint": str},
    "configuration": {"benchmark": str, "match_exact": bool, "match_normalized": bool, "match_near_duplicate": bool, "max_evidence_pairs": int, "row_index_base": int, "fail_on_overlap": bool, "max_overlap_rate?": float},
    "method": {
        "unit": str, "text_extraction": {"strategy": str, "candidate_fields": [str]}, "fingerprint": str, "row_index_base": int,
        "exact": str, "normalized": str, "near_duplicate": str, "text_exact": _SPEC, "text_normalized": _SPEC,
    },
    "result": {
        "exact_matches": int, "normalized_matches": int, "near_matches": int, "exact_rate": float, "normalized_rate": float, "status": str,
        "matches": {"exact": [_FOUND], "normalized": [_FOUND], "exact_truncated": bool, "normalized_truncated": bool},
    },
}


def check(value, model, at: str = "report"):
    """The value itself, if it is as the model says."""
    if isinstance(model, dict):
        if not isinstance(value, dict):
            raise ValueError(f"{at} should hold keys, not {value!r}")
        keys = {k.rstrip("?") for k in model}
        if odd := set(value) - keys | {k for k in model if not k.endswith("?") and k not in value}:
            raise ValueError(f"{at} has keys too many or too few: {', '.join(sorted(odd))}")
        for k, m in model.items():
            if (name := k.rstrip("?")) in value:
                check(value[name], m, f"{at}.{name}")
    elif isinstance(model, list):
        if not isinstance(value, list):
            raise ValueError(f"{at} should be a list, not {value!r}")
        for i, x in enumerate(value):
            check(x, model[0], f"{at}.{i}")
    else:
        kinds = (int, float) if model is float else model
        if not isinstance(value, kinds) or (model in (int, float) and isinstance(value, bool)):
            raise ValueError(f"{at} should be of type {model.__name__}, not {value!r}")
    return value
