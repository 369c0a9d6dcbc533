"""python -m variorum --old PAGES --new PAGES --out FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from variorum.plans.compare import run_comparison
from variorum.plans.options import Options
from variorum.session import ship


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="variorum", description="Compare two Parquet tables of document pages.")
    p.add_argument("--old", required=True)
    p.add_argument("--new", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--doc", nargs="+", default=["doc_id"], help="columns that name a document pair")
    p.add_argument("--profile", choices=["protocol", "general"], default="protocol")
    p.add_argument("--section-similarity", type=float, default=Options.section_similarity)
    p.add_argument("--snippets", type=int, default=Options.snippets)
    p.add_argument("--include-unchanged", action="store_true")
    for side in ("old", "new"):
        p.add_argument(f"--{side}-start-page", type=int)
        p.add_argument(f"--{side}-end-page", type=int)
    a = p.parse_args(argv)
    options = Options(section_similarity=a.section_similarity, snippets=a.snippets, include_unchanged=a.include_unchanged, profile=a.profile, old_start_page=a.old_start_page, old_end_page=a.old_end_page, new_start_page=a.new_start_page, new_end_page=a.new_end_page)
    spark = SparkSession.builder.appName("variorum").getOrCreate()
    ship(spark)
    run_comparison(spark, a.old, a.new, a.out, options, a.doc)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
