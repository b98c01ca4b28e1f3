"""Print the formatted physical plan of registered queries.

Usage: python tools/explain_query.py KEY [KEY ...] [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402


def main():
    p = argparse.ArgumentParser()
    p.add_argument("keys", nargs="+", choices=sorted(QUERIES))
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    args = p.parse_args()
    spark = build_session("local[8]", 8)
    for k in args.keys:
        print(f"===== {k}")
        QUERIES[k](spark, args.sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
