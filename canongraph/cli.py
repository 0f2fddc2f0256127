"""Command line: stable names of GFA files.

    python -m canongraph.cli [-i | -s] [-b] FILE...
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from canongraph.operators.canonical import cell_lines
from canongraph.operators.digest import ALGORITHMS, STREAM_FROM, digests
from canongraph.plans import naming
from canongraph.sources import gfa


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="canongraph", description="Stable names of graphs in GFA files")
    p.add_argument("files", nargs="*", help="GFA files")
    p.add_argument("-i", "--integer", action="store_true", help="read identifiers as integers (wins over -s)")
    p.add_argument("-s", "--string", action="store_true", help="read identifiers as strings")
    p.add_argument("-b", "--benchmark", action="store_true", help="statistics and the time of each digest, on stderr")
    args = p.parse_args(argv)
    if not args.files:
        p.print_usage(sys.stderr)
        return 1
    mode = "integer" if args.integer else "string" if args.string else "auto"
    spark = spark or SparkSession.builder.appName("canongraph").getOrCreate()
    for name in args.files:
        began = time.time()
        try:
            segments, links, errors = gfa.parse(gfa.read_lines(spark, name, numbered=False))
            wrong = bool(errors.limit(1).count())
        except Exception as e:  # a missing or unreadable file
            print(f"Error opening GFA file {name}: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
        if wrong:
            return _fail(spark, name, mode)
        if args.benchmark:
            found = naming.readable(segments, links, mode)
            if found is None:
                return _fail(spark, name, mode)
            rows, s = found[0], found[1].first()
            print(f"{name}: {time.time() - began:.3f} s; {s.nodes if s else 0} nodes, {s.edges if s else 0} edges, {s.seq_len if s else 0} bp", file=sys.stderr)
            text, large = cell_lines(rows), found[1].filter(f"text_bytes >= {STREAM_FROM}").select("graph_id")
            for algorithm in ALGORITHMS:
                began = time.time()
                digests(text, [algorithm], large=large).collect()
                print(f"{algorithm}: {time.time() - began:.3f} s", file=sys.stderr)
            continue
        got = naming.stable_names(segments, links, mode).select("digest").collect()
        if got:
            print(f"{got[0].digest}  {name}")
        elif not segments.limit(1).count() and not links.limit(1).count():
            print(f"{spark.range(1).select(F.sha2(F.lit(''), 256)).first()[0]}  {name}")  # an empty graph has an empty text
        else:
            return _fail(spark, name, mode)
    return 0


def _fail(spark: SparkSession, name: str, mode: str) -> int:
    """Prints the first error of a file; only now are its lines numbered."""
    print(gfa.first_errors(gfa.read_lines(spark, name), mode == "integer").first().message, file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
