"""python -m relata DIRECTORY [--save PATH] [--verbose]: builds a database of Parquet files, shows it, and saves its snapshot."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from relata.sources.database import RelDatabase


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="relata", description=__doc__)
    parser.add_argument("directory", help="holds db/*.parquet and tasks/<task>/{train,val,test}.parquet")
    parser.add_argument("--save", metavar="PATH", help="write rows, edges, cells and columns as a snapshot")
    parser.add_argument("--verbose", action="store_true", help="show tables, columns, texts, rows, edges, keys and degrees")
    found = parser.parse_args(args)
    spark = SparkSession.builder.appName("relata").getOrCreate()
    db = RelDatabase.directory(spark, found.directory)
    for name, df in db.describe().items():
        if found.verbose or name in ("counts", "tables"):
            print(name)
            df.show(50, truncate=60)
    if found.save:
        db.save(found.save)
        print(f"saved to {found.save}")


if __name__ == "__main__":
    main()
