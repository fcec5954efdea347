"""Command line: compute a feature of a Parquet dataset of bars, and look after the cache."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from barlume.operators.derived import derived_fields
from barlume.operators.store import FeatureCache, cache_key, data_fingerprint, usage
from barlume.sources.market import read_bars

FILTERS = ("symbol", "indicator", "timeframe", "older-than", "params-hash", "data-hash")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="barlume")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compute", help="midrange of bars, written to the cache")
    c.add_argument("input")
    c.add_argument("--symbol", required=True)
    c.add_argument("--timeframe", required=True)
    for name in ("compute", "stats", "list", "clean"):
        s = c if name == "compute" else sub.add_parser(name)
        s.add_argument("--root", required=True)
        if name in ("list", "clean"):
            for f in FILTERS:
                s.add_argument(f"--{f}")
        if name == "list":
            s.add_argument("--limit", type=int)
            s.add_argument("--offset", type=int, default=0)
        if name == "clean":
            s.add_argument("--all", action="store_true")
            s.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    cache = FeatureCache(spark, a.root)
    if a.command == "compute":
        bars = derived_fields(read_bars(spark, a.input))
        key = cache_key(a.symbol, a.timeframe, "midrange", {}, data_fingerprint(bars).first()["fingerprint"])
        cache.set(key, bars.select("symbol", "ts", "midrange"))
        print(key)
        return 0
    if a.command == "stats":
        usage(cache.entries()).orderBy("dimension", "name").show(1000, False)
        return 0
    filters = {f.replace("-", "_"): getattr(a, f.replace("-", "_")) for f in FILTERS}
    if a.command == "list":
        cache.query(**filters, limit=a.limit, offset=a.offset).orderBy("key").show(1000, False)
        return 0
    try:
        n, size = cache.clean(a.dry_run, a.all, **filters)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{n} entries, {size} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main())
