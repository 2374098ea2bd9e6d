"""Command line: python -m spindrift.cli {test, validate-notebook, audit-notebook, benchmark, smoke, query}."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path

from spindrift.functions import notebooks


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("test", help="run the tests in a process of their own")
    commands.add_parser("validate-notebook").add_argument("path")
    check = commands.add_parser("audit-notebook", help="patterns: a JSON file with required (lists) and forbidden")
    check.add_argument("path")
    check.add_argument("patterns")
    bench = commands.add_parser("benchmark")
    bench.add_argument("--samples", type=int, default=20_000)
    bench.add_argument("--output")
    commands.add_parser("smoke").add_argument("--live", action="store_true")
    query = commands.add_parser("query", help="run a registered query and show its first rows")
    query.add_argument("name")
    query.add_argument("sf_dir")
    args = parser.parse_args(argv)
    if args.command == "test":
        return subprocess.call([sys.executable, "-m", "pytest", "-q", "tests"])
    if args.command == "validate-notebook":
        found = notebooks.problems(args.path)
        print("\n".join(found) or "ok")
        return int(bool(found))
    if args.command == "audit-notebook":
        rules = json.loads(Path(args.patterns).read_text(encoding="utf-8"))
        missing, forbidden = notebooks.audit(args.path, rules.get("required", []), rules.get("forbidden", []))
        print(json.dumps({"missing": missing, "forbidden": forbidden}))
        return int(bool(missing or forbidden))

    from spindrift.operations import run_benchmark, run_smoke
    from spindrift.plans import catalogue, stores  # noqa: F401
    from spindrift.session import build_session

    spark = build_session("spindrift-cli")
    if args.command == "benchmark":
        print(json.dumps(run_benchmark(spark, args.samples, args.output), indent=2))
        return 0
    if args.command == "smoke":
        found = run_smoke(spark, args.live)
        print(json.dumps(asdict(found)))
        return 0 if found.ok else 1
    catalogue.QUERIES[args.name](spark, args.sf_dir).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
