"""Reports as text."""

from __future__ import annotations


def format_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    size = float(n)
    for unit in ("KB", "MB", "GB", "TB"):
        size /= 1024
        if size < 1024 or unit == "TB":
            return f"{size:.2f} {unit}"


def _table(rows: list[tuple], title: str) -> list[str]:
    rows = [tuple(map(str, r)) for r in rows]
    widths = [max(len(r[i]) for r in rows if len(r) > i) for i in range(max(map(len, rows)))] if rows else []
    return [title, "-" * 30, *("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows), ""]


def _gate(report: dict) -> list[str]:
    gate = report.get("gate")
    if gate is None:
        return []
    rows = [("metric", "actual", "threshold", "ok")] + [(r["metric"], f"{r['actual']:.6g}", f"{r['threshold']:.6g}", "yes" if r["passed"] else "no") for r in gate["rules"]]
    return _table(rows, f"Policy gate: {'PASSED' if gate['passed'] else 'FAILED'}")


def _end(report: dict, written: str) -> str:
    return "\n".join([*_gate(report), f"Report written to: {written}", *(f"* {n}" for n in report["notes"])])


def _head(report: dict) -> list[str]:
    return [f"{report['tool']} {report['version']}", ""]


def scan_text(report: dict, written: str) -> str:
    i, r, cfg = report["input"], report["result"], report["configuration"]["near_duplicates"]
    out = _head(report) + _table([("Path", i["path"]), ("Rows", f"{i['rows']:,}"), ("Format", i["format"]), ("Size", format_bytes(i["size_bytes"])), ("Columns", ", ".join(i["columns"]) or "(none)"), ("Fingerprint", r["fingerprint"])], "Dataset")
    e, n = r["exact_duplicates"], r["near_duplicates"]
    rows = [("Exact duplicates", f"{e['duplicate_records']:,}"), ("Unique records", f"{e['unique_records']:,}"), ("Duplicate rate", f"{e['duplicate_rate'] * 100:.2f}%")]
    if cfg["enabled"]:
        rows += [("Near-duplicate pairs", f"{n['pairs']:,}"), ("Records flagged", f"{n['records_flagged']:,}"), ("Near-duplicate rate", f"{n['record_rate'] * 100:.2f}%"), ("Threshold", f"{cfg['threshold']:.2f}"), ("Candidates", report["method"]["near_duplicates"]["candidate_generation"])]
    else:
        rows.append(("Near-duplicates", "skipped"))
    out += _table(rows, "Duplicates")
    if n["evidence"]:
        out += _table([("left", "right", "jaccard", "field")] + [(x["left"], x["right"], f"{x['jaccard']:.4f}", x.get("field", "-")) for x in n["evidence"][:5]], "Near-duplicates, first pairs")
    return "\n".join(out) + "\n" + _end(report, written)


def compare_text(report: dict, written: str) -> str:
    a, b, r = report["input"]["dataset_a"], report["input"]["dataset_b"], report["result"]
    out = _head(report) + _table([("", "A", "B"), *((k.capitalize(), a[k], b[k]) for k in ("path", "rows", "format", "fingerprint"))], "Datasets")
    field = report["method"].get("field")
    e, n, m = r["exact_overlap"], r["normalized_overlap"], r["matches"]
    rows = [("Unit", report["method"]["unit"])] + [("Field", field)] * bool(field)
    rows += [("Exact overlap", f"{e['shared_records']:,}"), ("Exact overlap rate", f"{e['rate']:.6g}"), ("Normalised overlap", f"{n['shared_records']:,}"), ("Normalised overlap rate", f"{n['rate']:.6g}"), ("Only in A (exact)", f"{e['only_in_a']:,}"), ("Only in B (exact)", f"{e['only_in_b']:,}"), ("Pairs shown (exact)", len(m["exact"])), ("Pairs shown (normalised)", len(m["normalized"]))]
    out += _table(rows, "Overlap")
    if some := m["exact"][:5] or m["normalized"][:5]:
        out += _table([("a row", "b row", *["field"] * bool(field)), *((x["dataset_a_record"], x["dataset_b_record"], *[field] * bool(field)) for x in some)], "First pairs")
    explained = [x for x in m["normalized"] if not x["also_exact"]][:3]
    lines: list[tuple] = []
    for x in explained:
        at = (x["dataset_a_record"], x["dataset_b_record"])
        if "difference" in x:
            lines.append((*at, x["difference"]["a"], x["difference"]["b"]))
        lines += [(*at, d["field"], d["a"], d["b"]) for d in x.get("differing_fields", [])[:3]]
    if lines:
        out += _table([("a row", "b row", *(["a", "b"] if field else ["field", "a", "b"])), *lines], "Alike only after stripping")
    return "\n".join(out) + "\n" + _end(report, written)


def benchmark_text(report: dict, written: str) -> str:
    i, r = report["input"], report["result"]
    out = _head(report) + _table([("Dataset", i["dataset"]["path"]), ("Benchmark", i["benchmark_name"]), ("Reference", i["reference_source"]), ("Benchmark records", f"{i['benchmark_records']:,}"), ("Dataset rows", f"{i['dataset']['rows']:,}"), ("Benchmark fingerprint", i["benchmark_fingerprint"])], "Benchmark")
    m = r["matches"]
    out += _table([("Exact matches", f"{r['exact_matches']:,}"), ("Exact match rate", f"{r['exact_rate']:.6g}"), ("Normalised matches", f"{r['normalized_matches']:,}"), ("Normalised match rate", f"{r['normalized_rate']:.6g}"), ("Near matches", "not looked for"), ("Status", r["status"]), ("Pairs shown (exact)", len(m["exact"])), ("Pairs shown (normalised)", len(m["normalized"]))], "Overlap")
    if some := m["exact"][:5] or m["normalized"][:5]:
        out += _table([("dataset row", "reference row", "field"), *((x["dataset_record"], x["reference_record"], x["field"]) for x in some)], "First pairs")
    return "\n".join(out) + "\n" + _end(report, written)
