"""The three audits as reports: input, configuration, method, result, and a gate if policies are given.

Reports are plain dictionaries in the order of their keys; keys without a value are left out.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.canonical import column, python_str, record_digest, text_digest
from ..functions.text import display
from ..operators.duplicates import PREFIX, TREE, TREE_PREFIX, exact_duplicates, fingerprint, tree_fingerprint
from ..operators.extraction import field_text, first_text
from ..operators.neardup import NearDuplicateConfig, near_duplicates
from ..operators.overlap import evidence, field_differences, match_rate, overlap_counts, overlap_rate
from ..sources.datasets import ROW, Dataset, read_dataset
from ..sources.references import get_adapter
from . import model

TOOL = "sievework"
FINGERPRINT = "normalized_record_multiset_sha256"
#: A report's own prefix asks for this fingerprint, or the other: see ``duplicates``.
_FINGERPRINTS = {TREE_PREFIX: (tree_fingerprint, TREE)}
MAX_EVIDENCE = 100
_NOTES = ["The report states its input, configuration, method and result.", "Results are technical evidence under the stated method, no verdict.", "Rows in evidence are counted from 0."]


def _strings(strip: bool) -> dict:
    return {"string_strip": strip, "collapse_internal_whitespace": False, "case_fold": False}


def record_spec(strip: bool) -> dict:
    notes = ["Strings lose white space at their ends only.", "No columns are excluded."] if strip else ["Strings are taken as they are."]
    return {"id": f"record_{'normalized' if strip else 'exact'}_v1", "includes_all_fields": True, "sort_object_keys": True, **_strings(strip), "serialization": "json_utf8_compact_sorted_keys", "hash": "sha256", "notes": notes}


def text_spec(strip: bool) -> dict:
    kind = "normalized" if strip else "exact"
    return {"id": f"text_{kind}_v1", "base_normalization": f"record_{kind}_v1", **_strings(strip), "serialization": "json_utf8_compact_sorted_keys_on_{text}", "hash": "sha256", "notes": ["One text is hashed as a record with the key text; method says where it comes from."]}


def near_text_spec() -> dict:
    return {"id": "near_text_v1", "prefer_text_column": True, "fallback": "join_sorted_string_fields", "lowercase": True, "collapse_whitespace": True, "notes": ["For near-duplicates only; fingerprints and exact matches don't use it."]}


def _shell(**parts) -> dict:
    return {"tool": TOOL, "version": __version__, "contract": "technical_audit", "disclaimer": "Technical evidence, no legal certification.", **{k: v for k, v in parts.items() if v is not None}}


def _digests(data: Dataset, strip: bool) -> DataFrame:
    return data.frame.select(F.col(ROW).alias("row"), record_digest(data.frame, strip, data.columns).alias("digest"))


def _fingerprint(digests: DataFrame, prefix: str) -> str:
    return _FINGERPRINTS.get(prefix, (fingerprint,))[0](digests, prefix)


def _fingerprint_kind(prefix: str) -> str:
    return _FINGERPRINTS[prefix][1] if prefix in _FINGERPRINTS else FINGERPRINT


def _reference(data: Dataset, digests: DataFrame, rows: int, prefix: str) -> dict:
    return {"path": data.path, "format": data.format, "rows": rows, "size_bytes": data.size_bytes, "columns": data.columns, "fingerprint": _fingerprint(digests, prefix)}


def scan(data: Dataset, near: NearDuplicateConfig | None = None, prefix: str = PREFIX) -> dict:
    """Structure, fingerprint, exact and near duplicates of one dataset. Digests are made once."""
    cfg = near or NearDuplicateConfig()
    digests = _digests(data, True).persist()
    exact = exact_duplicates(digests)
    rows = exact["total_records"]
    near_method, near_result = near_duplicates(data.frame, data.columns, ROW, cfg, rows)
    shingle = {"unit": "character", "size": cfg.shingle_size}
    method = {"similarity": "character_shingles+jaccard", "candidate_generation": near_method["candidate_generation"], "shingle": shingle, "minhash": near_method["minhash"], "text_prep": near_text_spec()}
    notes = [*_NOTES, "The fingerprint and exact duplicates are of whole records under record_normalized_v1."]
    notes += ["Near-duplicates are alike in their characters; paraphrases and translations are not found."] if cfg.enabled else ["Near-duplicates were not looked for."]
    report = _shell(
        input={"path": data.path, "format": data.format, "rows": rows, "size_bytes": data.size_bytes, "columns": data.columns},
        configuration={"row_index_base": 0, "near_duplicates": {"enabled": cfg.enabled, "threshold": cfg.threshold, "shingle": shingle, "num_perm": cfg.num_perm, "max_evidence_pairs": cfg.max_evidence if cfg.enabled else MAX_EVIDENCE}},
        method={"unit": "full_record", "fingerprint": _fingerprint_kind(prefix), "exact_duplicates": "record_normalized_v1 (stripped strings; compare's exact overlap uses record_exact_v1)", "row_index_base": 0, "record_normalized": record_spec(True), "near_duplicates": method},
        result={"fingerprint": _fingerprint(digests, prefix), "exact_duplicates": exact, "near_duplicates": near_result},
        notes=notes,
    )
    digests.unpersist()
    return model.check(report, model.SCAN)


def _stats(a: DataFrame, b: DataFrame) -> dict:
    r = overlap_counts(a, b).first().asDict()
    return {**r, "rate": overlap_rate(r["shared_records"], r["only_in_a"], r["only_in_b"])}


def _shown(data: Dataset, text_field: str, rows: set[int]) -> dict[int, str]:
    """The texts of a few rows as a report shows them."""
    if not rows:
        return {}
    few = F.broadcast(data.frame.sparkSession.createDataFrame([(r,) for r in rows], "row long"))
    return {r["row"]: r["shown"] for r in field_text(data.frame, text_field, ROW).join(few, "row").select("row", display(F.col("text")).alias("shown")).collect()}


def compare(a: Dataset, b: Dataset, max_evidence: int = MAX_EVIDENCE, text_field: str | None = None, prefix: str = PREFIX) -> dict:
    """Exact and normalised overlap of two datasets, over whole records or the texts of one field."""
    # each side is read once, for all of its digests; texts are read again for the pairs shown only
    sides = []
    for data in (a, b):
        record = record_digest(data.frame, True, data.columns)
        if text_field is None:
            d = data.frame.select(F.col(ROW).alias("row"), record_digest(data.frame, False, data.columns).alias("exact"), record.alias("normalized"))
        else:
            if text_field not in data.columns:
                raise ValueError(f"Column '{text_field}' not found in {data.path} (available: {', '.join(data.columns)})")
            text = python_str(column(text_field), data.frame.schema[text_field].dataType)
            d = data.frame.select(F.col(ROW).alias("row"), text_digest(text, False).alias("exact"), text_digest(text, True).alias("normalized"), record.alias("record"))
        sides.append(d.persist())
    left, right = (d.where(F.col("exact").isNotNull()) for d in sides)  # rows without a text have no digest of it

    def pick(side: DataFrame, kind: str, *more: str) -> DataFrame:
        return side.select("row", F.col(kind).alias("digest"), *more)

    stats = {k: _stats(pick(left, k), pick(right, k)) for k in ("exact", "normalized")}
    field = {} if text_field is None else {"field": text_field}
    found = evidence(pick(left, "exact"), pick(right, "exact"), max_evidence).collect()
    exact_truncated = len(found) > max_evidence
    exact_items = [{"dataset_a_record": r["a_row"], "dataset_b_record": r["b_row"], **field} for r in found[:max_evidence]]
    normalized = evidence(pick(left, "normalized", F.col("exact").alias("a_exact")), pick(right, "normalized"), max_evidence)
    few = left.sparkSession.createDataFrame(normalized.collect(), normalized.schema)  # at most max_evidence + 1 rows
    shown = few.join(F.broadcast(few.select("b_row").distinct()).join(right, F.col("row") == F.col("b_row")).select("b_row", F.col("exact").alias("b_exact")), "b_row")
    pairs = {(r["a_row"], r["b_row"]): r for r in shown.select("a_row", "b_row", (F.col("a_exact") == F.col("b_exact")).alias("also_exact")).collect()}
    truncated = len(pairs) > max_evidence
    keys = sorted(pairs)[:max_evidence]
    differing = {}
    unlike = [k for k in keys if not pairs[k]["also_exact"]]
    texts = [_shown(data, text_field, {k[i] for k in unlike}) if text_field else {} for i, data in enumerate((a, b))]
    if text_field is None and unlike:
        only = left.sparkSession.createDataFrame(unlike, "a_row long, b_row long")
        differing = {(r["a_row"], r["b_row"]): [d.asDict() for d in r["differing"]] for r in field_differences(a.frame, b.frame, ROW, ROW, only).collect()}
    items = []
    for k in keys:
        item = {"dataset_a_record": k[0], "dataset_b_record": k[1], **field, "also_exact": pairs[k]["also_exact"]}
        if not item["also_exact"]:
            item |= {"differing_fields": differing[k]} if text_field is None else {"difference": {"a": texts[0][k[0]], "b": texts[1][k[1]]}}
        items.append(item)
    refs = []
    for data, side in zip((a, b), sides):
        digests = side.select("row", F.col("normalized" if text_field is None else "record").alias("digest"))
        refs.append(_reference(data, digests, digests.count(), prefix))
    for s in sides:
        s.unpersist()
    whole = text_field is None
    unit = "full_record" if whole else "field_text"
    base = "record" if whole else "text"
    spec = record_spec if whole else text_spec
    method = {"unit": unit, **field, "exact_overlap": f"{base}_exact_v1", "normalized_overlap": f"{base}_normalized_v1", "fingerprint": _fingerprint_kind(prefix), "row_index_base": 0}
    method |= {"field_diff": "fields that differ as they are; only for pairs that are not also exact"} if whole else {}
    method |= {f"{base}_exact": spec(False), f"{base}_normalized": spec(True)}
    notes = [*_NOTES, "The overlap rate is shared digests over the smaller side's distinct digests.", "All fields of a record take part." if whole else f"Only the column '{text_field}' takes part.", "Exact evidence is pairs of rows; normalised evidence also says whether a pair is exact, and how it differs if not."]
    report = _shell(
        input={"dataset_a": refs[0], "dataset_b": refs[1]},
        configuration={"match_exact": True, "match_normalized": True, "max_evidence_pairs": max_evidence, "row_index_base": 0, **field, "fail_on_overlap": False},
        method=method,
        result={"exact_overlap": stats["exact"], "normalized_overlap": stats["normalized"], "matches": {"exact": exact_items, "normalized": items, "exact_truncated": exact_truncated, "normalized_truncated": truncated}},
        notes=notes,
    )
    return model.check(report, model.COMPARE)


def benchmark_check(data: Dataset, benchmark_id: str, reference: str | Path | None = None, max_evidence: int = MAX_EVIDENCE, prefix: str = PREFIX) -> dict:
    """Texts that a dataset shares with a benchmark's reference."""
    adapter = get_adapter(benchmark_id)
    spark = data.frame.sparkSession
    loaded = adapter.load_reference(spark, reference)
    fields = list(adapter.candidate_fields())
    own, other = (first_text(d.frame, fields, ROW).persist() for d in (data, loaded.dataset))
    matches, items, truncated = {}, {}, {}
    for k in ("exact", "normalized"):
        a, b = own.select("row", "field", F.col(k).alias("digest")), other.select("row", F.col(k).alias("digest"))
        matches[k] = overlap_counts(a, b).first()["shared_records"]
        found = evidence(a, b, max_evidence).collect()
        truncated[k] = len(found) > max_evidence
        items[k] = [{"dataset_record": r["a_row"], "reference_record": r["b_row"], "field": r["field"]} for r in found[:max_evidence]]
    digests, ref_digests = _digests(data, True).persist(), _digests(loaded.dataset, True)
    rows = digests.count()
    report = _shell(
        input={"dataset": _reference(data, digests, rows, prefix), "benchmark_id": adapter.id, "benchmark_name": adapter.name, "reference_source": loaded.source, "reference_path": loaded.path, "benchmark_records": loaded.dataset.rows(), "benchmark_fingerprint": _fingerprint(ref_digests, prefix)},
        configuration={"benchmark": adapter.id, "match_exact": True, "match_normalized": True, "match_near_duplicate": False, "max_evidence_pairs": max_evidence, "row_index_base": 0, "fail_on_overlap": False},
        method={"unit": "extracted_text", "text_extraction": {"strategy": "first_non_empty", "candidate_fields": fields}, "fingerprint": _fingerprint_kind(prefix), "row_index_base": 0, "exact": "text_exact_v1", "normalized": "text_normalized_v1", "near_duplicate": "disabled", "text_exact": text_spec(False), "text_normalized": text_spec(True)},
        result={
            "exact_matches": matches["exact"], "normalized_matches": matches["normalized"], "near_matches": 0,
            "exact_rate": match_rate(matches["exact"], rows), "normalized_rate": match_rate(matches["normalized"], rows),
            "status": "OVERLAP_DETECTED" if any(matches.values()) else "NO_OVERLAP_DETECTED",
            "matches": {"exact": items["exact"], "normalized": items["normalized"], "exact_truncated": truncated["exact"], "normalized_truncated": truncated["normalized"]},
        },
        notes=[*_NOTES, "The match rate is distinct matched texts over all rows of the dataset.", f"A record's text is its first field of {fields} that is not blank; its other fields don't count.", *adapter.notes_for_reference(loaded.source)],
    )
    for x in (own, other, digests):
        x.unpersist()
    return model.check(report, model.BENCHMARK)


def with_gate(report: dict, gate: dict | None, **policy) -> dict:
    """The report with its gate, and the policies that it judged in the configuration."""
    if gate is None:
        return report
    given = {k: v for k, v in policy.items() if v is not None}
    notes = report["notes"]
    return {**{k: v for k, v in report.items() if k != "notes"}, "configuration": report["configuration"] | given, "gate": gate, "notes": notes}


def scan_dataset(spark: SparkSession, path, near: NearDuplicateConfig | None = None, prefix: str = PREFIX, **options) -> dict:
    return scan(read_dataset(spark, path, **options), near, prefix)


def compare_datasets(spark: SparkSession, path_a, path_b, max_evidence: int = MAX_EVIDENCE, text_field: str | None = None, prefix: str = PREFIX, **options) -> dict:
    return compare(read_dataset(spark, path_a, **options), read_dataset(spark, path_b, **options), max_evidence, text_field, prefix)


def check_benchmark(spark: SparkSession, path, benchmark_id: str, reference=None, max_evidence: int = MAX_EVIDENCE, prefix: str = PREFIX, **options) -> dict:
    get_adapter(benchmark_id)  # an unknown id fails before any file is opened
    return benchmark_check(read_dataset(spark, path, **options), benchmark_id, reference, max_evidence, prefix)
