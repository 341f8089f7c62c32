"""Command line: `python -m melisma.cli pipeline DATA OUT [--start-from S] [--stop-after S]`, `query NAME DATA OUT`, `list`, `velocity-table`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="melisma")
    verbs = parser.add_subparsers(dest="verb", required=True)
    from melisma.plans.pipeline import STAGES

    p = verbs.add_parser("pipeline", help="run the corpus stages")
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--start-from", choices=list(STAGES))
    p.add_argument("--stop-after", choices=list(STAGES))
    q = verbs.add_parser("query", help="write one query's rows as Parquet")
    for a in ("name", "data", "out"):
        q.add_argument(a)
    verbs.add_parser("list", help="names of all queries")
    verbs.add_parser("velocity-table", help="velocity of every bin")
    args = parser.parse_args(argv)

    from melisma.plans import catalogue, pipeline

    if args.verb == "list":
        print("\n".join(sorted(catalogue.queries())))
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "pipeline":
        pipeline.run(spark, args.data, args.out, args.start_from, args.stop_after)
    elif args.verb == "query":
        catalogue.queries()[args.name](spark, args.data).write.mode("overwrite").parquet(args.out)
    else:
        catalogue.queries()["f3_velocity_table"](spark, "").orderBy("bin").show(truncate=False)


if __name__ == "__main__":
    main()
