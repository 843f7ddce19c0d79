"""python -m lading list|test|extract ARCHIVES…: listings and extraction from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lading", description=__doc__)
    p.add_argument("--password", "-p")
    p.add_argument("--encoding", "-e", help="encoding of names that don't say theirs; see names.encodings()")
    p.add_argument("--depth", type=int, default=0, help="levels of archives in archives that are opened")
    p.add_argument("--indexes", "-i", type=int, action="append", help="only the entry with this index; may be given again")
    p.add_argument("--files", "-f", action="append", help="only entries whose path fits this glob; may be given again")
    commands = p.add_subparsers(dest="command", required=True)
    ls = commands.add_parser("list", help="a line an entry")
    ls.add_argument("--long", "-l", action="store_true")
    ls.add_argument("--very-long", "-L", action="store_true", help="all that is known of each entry")
    ls.add_argument("--json", "-j", action="store_true")
    commands.add_parser("test", help="read each entry and tell how it went")
    x = commands.add_parser("extract", help="write entries below a folder")
    x.add_argument("--output-directory", "-o", default="file:///tmp/extracted", help="a URI")
    x.add_argument("--forks", "-k", choices=("visible", "hidden", "hfv", "none"), default="visible")
    collisions = x.add_mutually_exclusive_group()
    for name in ("overwrite", "skip", "rename"):
        collisions.add_argument(f"--force-{name}", dest="on_collision", action="store_const", const=name)
    x.add_argument("--no-directory", "-D", action="store_true", help="no folder of its own for an archive")
    for c in commands.choices.values():
        c.add_argument("archives", nargs="+", help="paths, globs or URIs")
    return p


def chosen(entries: DataFrame, args: argparse.Namespace) -> DataFrame:
    from .functions.columns import components, in_indexes, matches_any, sanitised

    return entries.where(in_indexes(F.col("idx"), args.indexes or []) & matches_any(sanitised(components(F.col("name"))), args.files or []))


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, int]:
    """A table of lines to print, and the exit code: 1 if an entry failed."""
    from .plans.extract import failed_files, planned, with_directory_attributes, written
    from .plans.listing import described, json_line, long_line, short_line
    from .sources.reader import Options, list_entries

    options = Options(content=args.command == "extract", test=args.command != "list", depth=args.depth, password=args.password, encoding=args.encoding)
    entries = chosen(list_entries(spark.read.format("binaryFile").load(args.archives), options), args)
    if args.command == "list":
        if args.very_long:
            return described(entries).select(F.concat_ws(": ", "label", "value").alias("line")), 0
        line = json_line(*(c for c in entries.columns if c != "content")) if args.json else long_line(F.rpad(F.substring(F.coalesce("compression", F.lit("None")), 1, 4), 4, "-")) if args.long else short_line()
        return entries.orderBy("archive", "idx").select(line.alias("line")), 0
    if args.command == "test":
        lines = entries.orderBy("archive", "idx").select(F.concat_ws("  ", F.coalesce("status", F.lit("unknown")), "name").alias("line"))
        return lines, int(not entries.where("status not in ('ok', 'not_tested') or archive_status is not null").isEmpty())
    plan = planned(entries, args.forks, args.on_collision or "rename", not args.no_directory)
    results = written(plan, args.output_directory).persist()  # a part that is lost is written again, to the same effect
    results.count()
    with_directory_attributes(plan, args.output_directory).count()
    return results.orderBy("archive", "idx").select(F.concat_ws("  ", "result", "target").alias("line")), int((failed_files(results).agg(F.sum("failed")).first()[0] or 0) > 0)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    lines, code = run(spark, args)
    for row in lines.toLocalIterator():
        print(row.line)
    return code


if __name__ == "__main__":
    sys.exit(main())
