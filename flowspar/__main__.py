"""Command line: python -m flowspar DIRECTORY [options]."""

from __future__ import annotations

import argparse
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowspar", description="Finds flows of untrusted input in a source tree.")
    p.add_argument("directory")
    p.add_argument("--language")
    p.add_argument("--framework")
    p.add_argument("--rules", action="append", help="rule file or folder; may be repeated (default: ./rules where it exists)")
    p.add_argument("--max-findings", type=int, default=50, help="findings of each category")
    p.add_argument("-o", "--output", help="write the report here, with .elements.json and .canonical.json next to it")
    p.add_argument("--no-canonical", action="store_true")
    p.add_argument("--no-elements", action="store_true")
    p.add_argument("--no-blind-spots", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--cache", help="folder for parsed facts")
    p.add_argument("--enable-container-bridge", action="store_true")
    p.add_argument("--enable-state-bridge", action="store_true")
    p.add_argument("--master", default=None, help="Spark master, if not set by spark-submit")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from flowspar.plans.scan import scan

    builder = SparkSession.builder.appName("flowspar")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    rules = a.rules or (["rules"] if Path("rules").is_dir() else None)
    found = scan(spark, a.directory, a.language, a.framework, a.max_findings, not a.no_blind_spots, bool(a.cache) and not a.no_cache, None, rules, cache=a.cache, enable_container_bridge=a.enable_container_bridge, enable_state_bridge=a.enable_state_bridge)
    print(found.to_text())
    if a.output:
        out = Path(a.output)
        out.write_text(found.to_json(), encoding="utf-8")
        if not a.no_elements:
            out.with_suffix(".elements.json").write_text(found.to_elements_json(), encoding="utf-8")
        if not a.no_canonical:
            out.with_suffix(".canonical.json").write_text(found.to_canonical_json(), encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
