"""Command line: ``python -m sievework.cli scan|compare|benchmark-check``. Exit codes: 0 done, 1 input or usage, 2 a gate failed."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from .operators import gates
from .operators.duplicates import PREFIX, TREE_PREFIX
from .operators.neardup import NearDuplicateConfig
from .plans import reports, terminal
from .session import local_session
from .sources.sinks import write_json_report

DONE, ERROR, POLICY = 0, 1, 2


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(ERROR, f"Error: {message}\n")


def _number(kind: type, low: float, high: float = float("inf")) -> Callable[[str], float]:
    def check(text: str):
        value = kind(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{text} is not within {low:g} and {high:g}")
        return value

    return check


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="sievework", description="Audit datasets with Spark.")
    commands = p.add_subparsers(dest="command", parser_class=_Parser)
    rate = _number(float, 0, 1)
    scan = commands.add_parser("scan", help="structure, fingerprint, exact and near duplicates of a dataset")
    scan.add_argument("path")
    scan.add_argument("--near-duplicate-threshold", type=rate, default=0.85)
    scan.add_argument("--shingle-size", type=_number(int, 1), default=5)
    scan.add_argument("--num-perm", type=_number(int, 4), default=64)
    scan.add_argument("--skip-near-duplicates", action="store_true")
    scan.add_argument("--max-duplicate-rate", type=rate)
    scan.add_argument("--max-near-duplicate-rate", type=rate)
    compare = commands.add_parser("compare", help="overlap of two datasets")
    compare.add_argument("path_a")
    compare.add_argument("path_b")
    compare.add_argument("--text-field")
    bench = commands.add_parser("benchmark-check", help="overlap of a dataset with a benchmark's reference")
    bench.add_argument("path")
    bench.add_argument("-b", "--benchmark", required=True)
    bench.add_argument("--reference")
    for c, name in ((scan, "report"), (compare, "compare"), (bench, "benchmark")):
        c.add_argument("-o", "--output", default=f"sievework-{name}.json")
        c.add_argument("--max-evidence", type=_number(int, 1), default=reports.MAX_EVIDENCE)
        c.add_argument("--tree-fingerprint", action="store_true", help="a fingerprint without a stream of all digests, for large tables")
        c.add_argument("--allow-directory", action="store_true", help="take folders of files too")
    for c in (compare, bench):
        c.add_argument("--fail-on-overlap", action="store_true")
        c.add_argument("--max-overlap-rate", type=rate)
    return p


def _run(args: argparse.Namespace, spark) -> tuple[dict, str]:
    more = {"allow_directory": args.allow_directory, "prefix": TREE_PREFIX if args.tree_fingerprint else PREFIX}
    if args.command == "scan":
        near = NearDuplicateConfig(threshold=args.near_duplicate_threshold, shingle_size=args.shingle_size, num_perm=args.num_perm, enabled=not args.skip_near_duplicates, max_evidence=args.max_evidence)
        report = reports.scan_dataset(spark, args.path, near, **more)
        policy = {"max_duplicate_rate": args.max_duplicate_rate, "max_near_duplicate_rate": args.max_near_duplicate_rate}
        return reports.with_gate(report, gates.scan_gate(report, **policy), **policy), "scan"
    policy = {"fail_on_overlap": args.fail_on_overlap, "max_overlap_rate": args.max_overlap_rate}
    if args.command == "compare":
        report = reports.compare_datasets(spark, args.path_a, args.path_b, args.max_evidence, args.text_field, **more)
        return reports.with_gate(report, gates.compare_gate(report, **policy), **policy), "compare"
    report = reports.check_benchmark(spark, args.path, args.benchmark, args.reference, args.max_evidence, **more)
    return reports.with_gate(report, gates.benchmark_gate(report, **policy), **policy), "benchmark"


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command is None:
        p.print_help()
        return DONE
    try:
        report, kind = _run(args, spark or local_session())
    except (FileNotFoundError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return ERROR
    written = write_json_report(report, args.output)
    print(getattr(terminal, f"{kind}_text")(report, str(written)))
    gate = report.get("gate")
    if gate and not gate["passed"]:
        failed = ", ".join(f"{r['metric']}={r['actual']:.6g}>{r['threshold']:.6g}" for r in gate["rules"] if not r["passed"])
        print(f"Policy gate failed ({failed}); exit {POLICY}.", file=sys.stderr)
        return POLICY
    return DONE


if __name__ == "__main__":
    sys.exit(main())
