"""Command line: ``python -m siltstone PATH... [options]``. Exit codes: 0, 1 without inputs, 130 if interrupted."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .settings import LOG_LEVELS, MODES, Settings
from .sinks import csv_report, files
from .sources import scan


class OneLevel(logging.Filter):
    """Passes records of exactly one level, as the console does."""

    def __init__(self, level: int):
        super().__init__()
        self.level = level

    def filter(self, record: logging.LogRecord) -> bool:
        return record.levelno == self.level


def set_up_logging(level: str, log_file: str | None, quiet: bool) -> None:
    root = logging.getLogger("siltstone")
    root.setLevel(logging.DEBUG)
    root.handlers.clear()
    if not quiet and level != "none":
        console = logging.StreamHandler()
        console.addFilter(OneLevel(getattr(logging, level.upper())))
        root.addHandler(console)
    if log_file:
        root.addHandler(logging.FileHandler(log_file, mode="w"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description="Lossless recompression of files and of what they contain.")
    p.add_argument("inputs", nargs="*")
    p.add_argument("-o", "--output")
    p.add_argument("--report")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--no-meta", action="store_true")
    p.add_argument("--verify-checksums", action="store_true", default=True)
    p.add_argument("--threads", type=int)
    p.add_argument("--mode", choices=MODES, default="pipe")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--log-level", choices=LOG_LEVELS, default="error")
    p.add_argument("--log-file")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not a.inputs:
        print("no inputs", file=sys.stderr)
        return 1
    set_up_logging(a.log_level, a.log_file, a.quiet)
    settings = Settings(not a.no_meta, True, a.dry_run, a.recursive, a.mode, a.output, a.report, tuple(a.include), tuple(a.exclude), a.log_level, partitions=a.threads)
    settings.check_stdin(a.inputs)
    spark = SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, settings)
    try:
        if a.inputs == ["-"]:
            data = sys.stdin.buffer.read()
            row = engine.run_files(scan.stdin_files(spark, data)).results.where(F.col("container_origin").isNull()).select("new_content").first()
            if not a.dry_run:  # to standard output and to the file
                best = bytes(row.new_content) if row.new_content is not None else data
                sys.stdout.buffer.write(best)
                files.replace(best, a.output)
            return 0
        run = engine.recompress(a.inputs)
    except KeyboardInterrupt:
        return 130
    if not a.quiet:
        print(csv_report.console_table(run.results.where(F.col("container_origin").isNull())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
