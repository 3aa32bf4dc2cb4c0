"""python -m voxmill.cli PAGES --app ID: insights of a folder of feed pages, as .md, .html or .json, or JSON on the output."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from voxmill.operators.sentiment import prepare
from voxmill.plans import insights, report
from voxmill.sources import feed


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxmill")
    p.add_argument("pages")
    p.add_argument("--app", default="app")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        found = insights.build(prepare(feed.collect(feed.read_pages(spark, a.pages), a.limit, a.seed)).cache())
    except (feed.NotFound, feed.Upstream, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    app = {"name": a.app}
    text = report.markdown(app, found) if (a.out or "").endswith(".md") else report.html(app, found) if (a.out or "").endswith(".html") else json.dumps(found, ensure_ascii=False, indent=2)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
