"""python -m quillon tables|schema|find|join|explain FOLDER [TABLE] [DOCUMENT]: documents over the tables of a folder; rows as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import RowStream
from .errors import QueryError, StoreError
from .sources.catalog import Catalog


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("command", choices=["tables", "schema", "find", "join", "explain"])
    p.add_argument("folder")
    p.add_argument("rest", nargs="*", help="find, explain: table and document; join: document; schema: table")
    p.add_argument("--at", type=int, help="a version of stores")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    catalog = Catalog(spark, a.folder)
    try:
        if a.command == "tables":
            print("\n".join(catalog.table_names()))
        elif a.command == "schema":
            print(catalog.schema_json(*a.rest))
        elif a.command == "explain":
            print(catalog.engine(a.at).explain(*a.rest)["plan"])
        else:
            engine = catalog.engine(a.at)
            for line in RowStream(engine.join(*a.rest) if a.command == "join" else engine.find(*a.rest)).json():
                print(line)
    except (QueryError, StoreError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
