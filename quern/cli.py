"""Run a batch and print one JSON object for each statement: python -m quern.cli --db FOLDER [--sql TEXT | --catalogo]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quern.session import Database, Session


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--db", required=True)
    p.add_argument("--sql")
    p.add_argument("--catalogo", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("quern").getOrCreate()
    db = Database(spark, a.db)
    if a.catalogo:
        print(db.catalog.to_json())
        return
    print("[" + ",\n".join(r.to_json() for r in Session(db).run(a.sql or sys.stdin.read())) + "]")


if __name__ == "__main__":
    main()
