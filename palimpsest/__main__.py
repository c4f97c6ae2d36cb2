"""Command line: python -m palimpsest FOLDER [--archive FOLDER] [--common FOLDER] ..."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from palimpsest import __version__
from palimpsest.config import DetectionConfig, read_config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest", description="Find text reuse in a folder of documents.")
    out.add_argument("folder", help="documents")
    out.add_argument("-R", "--recursive", action="store_true", help="read folders below as well")
    out.add_argument("-a", "--archive", help="documents that are compared with the others only")
    out.add_argument("-A", "--recursive-archive", action="store_true")
    out.add_argument("-c", "--common", help="documents whose lines count for nothing")
    out.add_argument("-C", "--recursive-common", action="store_true")
    out.add_argument("-l", "--lang", help="language of the documents")
    out.add_argument("-s", "--similarity", type=float, help="threshold of all similarities, 0 to 1")
    out.add_argument("--config", help="settings file")
    out.add_argument("--cache", help="folder that keeps prepared sentences")
    out.add_argument("-j", "--json", help="folder for JSON reports; without it the report is printed")
    out.add_argument("--version", action="version", version=__version__)
    return out


def settings(args: argparse.Namespace) -> DetectionConfig:
    config = read_config(args.config) if args.config else DetectionConfig()
    if args.lang:
        config = replace(config, lang=args.lang)
    return config.with_similarity(args.similarity) if args.similarity is not None else config


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = settings(args)
    from pyspark.sql import SparkSession

    from palimpsest.detection import find_matches
    from palimpsest.sinks import reports
    from palimpsest.sources import files

    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    read = lambda folder, deep: files.documents(files.scan(spark, folder, deep)) if folder else None
    found = find_matches(read(args.folder, args.recursive), read(args.archive, args.recursive_archive), read(args.common, args.recursive_common), config, args.cache)
    if args.json:
        reports.write_json(found.matches, found.docs, args.json)
    else:
        print(reports.text_report(found.matches, found.docs))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
