"""Run one registered job and write its result.

    spark-submit --conf spark.checkpoint.dir=<shared folder> -m mercata \\
        top_owner_report --tables <folder of the input tables> --out <output folder> [--format csv]

The output is partitioned by ``month`` when the result has that column; ``--explain`` prints the
formatted physical plan (pushed filters, read schemas, shuffles, join strategies) instead.
"""

from __future__ import annotations

import argparse

from mercata.plans.catalog import REGISTRY
from mercata.session import get_session
from mercata.sources.sinks import write_csv, write_parquet


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="mercata")
    ap.add_argument("job", choices=sorted(REGISTRY))
    ap.add_argument("--tables", required=True, help="folder holding <table>.parquet inputs")
    ap.add_argument("--out", help="output folder (required unless --explain)")
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan instead")
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    ap.add_argument("--master", default=None, help="only for local runs; spark-submit sets it otherwise")
    a = ap.parse_args(argv)
    spark = get_session(a.master, app_name=f"mercata-{a.job}")
    df = REGISTRY[a.job](spark, a.tables)
    if a.explain:
        df.explain("formatted")
        return
    if not a.out:
        ap.error("--out is required")
    parts = ["month"] if "month" in df.columns else []
    (write_csv if a.format == "csv" else write_parquet)(df, a.out, partition_by=parts)


if __name__ == "__main__":
    main()
