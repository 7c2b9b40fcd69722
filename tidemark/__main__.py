"""The whole analysis from a shell: ``python -m tidemark {village,wiki,table} --dir FOLDER``; reports go to ``--out``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import analysis
from .plans.frame import PairConfig, canonical
from .sources import tables, village, wiki

#: Events that a mode reads at most.
MODES = {"quick": 5_000, "medium": 100_000, "whole": None}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("source", choices=("village", "wiki", "table"), help="the layout of --dir; table: Parquet with the columns of an event")
    parser.add_argument("--dir", required=True, help="a local or Hadoop path")
    parser.add_argument("--start", help="first time, UTC")
    parser.add_argument("--end", help="first time no longer read, UTC")
    parser.add_argument("--mode", choices=MODES, default="quick", help="how many events at most: 5,000, 100,000, all")
    parser.add_argument("--max-events", type=int, help="instead of the mode's")
    parser.add_argument("--window-minutes", type=float, default=PairConfig.window_minutes, help="how long before an event its influences lie")
    parser.add_argument("--out", default="reports", help="folder of the reports")
    parser.add_argument("--list-days", action="store_true", help="village: show the busiest days and stop")
    args = parser.parse_args(argv)
    if args.list_days and args.source != "village":
        parser.error("--list-days is for village")
    if args.source == "village" and not args.list_days and not (args.start and args.end):
        parser.error("village needs --start and --end (--list-days shows days)")
    return args


def load(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, dict]:
    """The events to analyse and what is known about them."""
    most = MODES[args.mode] if args.max_events is None else args.max_events
    if args.source == "village":
        raw = village.read(spark, args.dir)
        path = f"{args.dir}/CHANGELOG.md"
        log = tables.changelog(spark, path) if tables.exists(spark, path) else spark.createDataFrame([], "day date, body string")
        return village.load_window(raw, args.start, args.end, most), village.slice_context(raw, log, args.start, args.end, most).first().asDict(recursive=True)
    if args.source == "wiki":
        ev = wiki.load(spark, args.dir, args.start, args.end, most)
        return ev, wiki.slice_context(spark, args.dir, ev).first().asDict(recursive=True)
    ev = spark.read.parquet(args.dir)
    if args.start:
        ev = ev.where(F.col("timestamp") >= F.lit(args.start).cast("timestamp"))
    if args.end:
        ev = ev.where(F.col("timestamp") < F.lit(args.end).cast("timestamp"))
    ev = ev if most is None else ev.orderBy("timestamp", "event_id").limit(most)
    return canonical(ev.drop("us", "rn", "res")), {"table": args.dir}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.list_days:
        for day in village.busiest_days(village.daily_activity(village.read(spark, args.dir)["chat_messages"])).collect():
            print(f"{day.day}  {day.messages} messages, {day.url_messages} with links, {day.speakers} speakers")
        return 0
    ev, context = load(spark, args)
    cfg = analysis.AnalysisConfig(pairs=PairConfig(window_minutes=args.window_minutes))
    result = analysis.run_pipeline(ev, cfg, context)
    name = "-".join([args.source, *[t.replace(" ", "T").replace(":", "") for t in (args.start, args.end) if t]])
    for path in analysis.write_report(result, args.out, name):
        print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
