"""python -m webloom.cli get|put|scan|delete|rename|tables ...: saved tables of cells (key, column, value) from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.sources import kv
from webloom.workspace import written

CELLS = "key string, column string, value string"


def put(spark: SparkSession, table: str, row: str, column: str, value: str) -> None:
    tables = kv.Catalog(spark)
    old: DataFrame = tables.read(table) if tables.exists(table) else spark.createDataFrame([], CELLS)
    fresh = spark.createDataFrame([(row, column, value, 0)], CELLS + ", at int")
    tables.write(table, written(kv.put_cells(old, fresh, ["at"]), "cli-put"))  # a table can't be overwritten while it is read


def get(spark: SparkSession, table: str, row: str, column: str) -> str | None:
    cells = kv.Catalog(spark).read(table)
    found = [] if cells is None else kv.get_row(cells, row).where(F.col("column") == column).select("value").collect()
    return found[0].value if found else None


def scan(spark: SparkSession, table: str, start: str | None = None, end: str | None = None) -> list[tuple[str, str, str]]:
    cells = kv.Catalog(spark).read(table)
    return [] if cells is None else [tuple(r) for r in kv.scan(cells, start, end).orderBy("key", "column").collect()]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="webloom.cli", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in (("get", "table row column"), ("put", "table row column value"), ("scan", "table"), ("delete", "table"), ("rename", "old new"), ("tables", "")):
        own = verbs.add_parser(verb)
        for name in names.split():
            own.add_argument(name)
        if verb == "scan":
            own.add_argument("start", nargs="?")
            own.add_argument("end", nargs="?")
    a = parser.parse_args(args)
    if spark is None:
        from webloom.session import session

        spark = session()
    tables = kv.Catalog(spark)
    if a.verb == "get":
        value = get(spark, a.table, a.row, a.column)
        print("" if value is None else value)
    elif a.verb == "put":
        put(spark, a.table, a.row, a.column, a.value)
    elif a.verb == "scan":
        for row in scan(spark, a.table, a.start, a.end):
            print("\t".join(row))
    elif a.verb == "delete":
        tables.delete(a.table)
    elif a.verb == "rename":
        tables.rename(a.old, a.new)
    else:
        print("\n".join(tables.tables()))


if __name__ == "__main__":
    main()
