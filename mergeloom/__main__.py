"""Merge two CSV tables from the command line: python -m mergeloom left.csv right.csv out_folder."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .plans.integrate import Config, integrate, stack_tables
from .sources import tables


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="mergeloom", description=__doc__)
    p.add_argument("left")
    p.add_argument("right")
    p.add_argument("out", help="folder of the merged table; the audit goes beside it")
    p.add_argument("--aliases", help="stack by column categories of this alias file, instead of matching rows")
    p.add_argument("--schema-threshold", type=float, default=Config().schema_threshold)
    p.add_argument("--rounds", type=int, default=1)
    p.add_argument("--restore", action="store_true", help="show the merged table in the formats of the left one")
    p.add_argument("--log", help="append what is done to this file")
    a = p.parse_args(args)
    log = logging.getLogger("mergeloom")
    if a.log:
        log.addHandler(logging.FileHandler(a.log))
        log.setLevel(logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    left, right = (tables.read_table(spark, x) for x in (a.left, a.right))
    if a.aliases:
        tables.write_table(stack_tables(left, right, tables.read_aliases(spark, a.aliases)), a.out)
        log.info("stacked %s and %s", a.left, a.right)
        return
    result = integrate(left, right, Config(schema_threshold=a.schema_threshold, rounds=a.rounds, restore=a.restore))
    log.info("columns: %s", result.schema_map)
    tables.write_table(result.merged, a.out)
    tables.write_table(result.matches, f"{a.out.rstrip('/')}-matches")
    log.info("merged %s and %s", a.left, a.right)


if __name__ == "__main__":
    main()
