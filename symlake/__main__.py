"""Command line: the state of a project, of a file or a symbol in it, one file's analysis, or JSON commands from standard input."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="symlake", description="Structure of a source tree as JSON.")
    parser.add_argument("root", nargs="?", default="", help="folder of the project")
    parser.add_argument("-p", "--path", default="", help="file to select, relative to the folder")
    parser.add_argument("-s", "--symbol", type=int, help="index of the symbol to select in that file")
    parser.add_argument("-i", "--interactive", action="store_true", help="answer JSON commands from standard input")
    parser.add_argument("--dump-file", default="", help="analyse one file and print nothing else")
    given = parser.parse_args(arguments)

    from .plans.project import from_texts
    from .plans.session import Session, analyses_json, documents

    spark = SparkSession.builder.appName("symlake").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if given.dump_file:
        folder, name = os.path.split(os.path.abspath(given.dump_file))
        text = spark.read.text(os.path.join(folder, name), wholetext=True).select(F.lit(folder).alias("root"), F.lit(name).alias("rel_path"), F.col("value").alias("text"))
        print(analyses_json(documents(from_texts(text, any_suffix=True))).first()["value"])
        return 0
    session = Session(spark)
    if given.root:
        session.set_root_path(os.path.abspath(given.root))
    if given.path:
        session.select_path(given.path)
    if given.symbol is not None:
        session.select_symbol(given.symbol)
    if given.interactive:
        for answer in session.run(sys.stdin):
            print(answer, flush=True)
        return 0
    if not given.root:
        parser.print_usage(sys.stderr)
        return 1
    print(next(session.run(['{"command": "getState"}'])))
    return 0


if __name__ == "__main__":
    sys.exit(main())
