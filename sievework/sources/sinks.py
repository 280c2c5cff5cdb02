"""Report files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_json_report(report, path: str | Path) -> Path:
    """A report (a dict, or what has ``to_dict``) as indented UTF-8 JSON; folders are made. Returns the absolute path."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    content = report.to_dict() if hasattr(report, "to_dict") else report
    with target.open("w", encoding="utf-8") as f:
        json.dump(content, f, ensure_ascii=False, indent=2)
        f.write("\n")
    return target.resolve()


def write_evidence(evidence: DataFrame, path: str, kind: str = "parquet") -> None:
    """All evidence rows, however many, as Parquet or JSON lines."""
    evidence.write.format("json" if kind == "jsonl" else kind).save(path)
