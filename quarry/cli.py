"""python -m quarry.cli PATH QUERY [--rebuild]: the ten best chunks of a source tree as JSON."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quarry.output import as_json
from quarry.plans.hybrid import query_frame
from quarry.store import load_or_build

TOP = 10


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description="Search a source tree.")
    parser.add_argument("path", help="directory to scan, or to load from ~/.quarry")
    parser.add_argument("query")
    parser.add_argument("--rebuild", action="store_true", help="build the index again")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    if not args.query.strip():
        print(json.dumps({"query": args.query, "results": []}, ensure_ascii=False, indent=2))
        return
    found = load_or_build(spark, args.path, rebuild=args.rebuild).search_batch([args.query], TOP)
    row = as_json(found, query_frame(spark, [args.query])).first()
    print(json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
