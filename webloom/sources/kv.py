"""Keyed tables: rows of a string key and a map of columns, or any DataFrame with a key column.

Reads are plain filters on the key, which Parquet statistics prune; writes are whole-table rewrites that
combine the old rows with a batch of changes, each by one shuffle on the key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from webloom.workspace import written


def scan(table: DataFrame, start: str | None = None, end: str | None = None, key: str = "key") -> DataFrame:
    """Rows with start <= key < end; either bound may be open."""
    if start is not None:
        table = table.where(F.col(key) >= start)
    return table if end is None else table.where(F.col(key) < end)


def get_row(table: DataFrame, row: str, key: str = "key") -> DataFrame:
    return table.where(F.col(key) == row)


def get_cell(table: DataFrame, row: str, column: str, key: str = "key") -> DataFrame:
    """One row at most; none if the row or the column is missing."""
    values = dict(table.dtypes).get("values", "")
    cell = F.try_element_at("values", F.lit(column)) if values.startswith("map") else F.col(column) if column in table.columns else F.lit(None)
    return get_row(table, row, key).select(cell.alias("value")).where("value is not null")


def exists_row(table: DataFrame, row: str, key: str = "key") -> bool:
    return not get_row(table, row, key).isEmpty()


def count(table: DataFrame, key: str = "key") -> int:
    """Distinct keys."""
    return table.select(key).distinct().count()


def latest_cells(puts: DataFrame, order: list[str]) -> DataFrame:
    """``key, column, value`` from a log of puts: of each cell the one that comes last by ``order``."""
    return puts.groupBy("key", "column").agg(F.max_by("value", F.struct(*order)).alias("value"))


def put_cells(cells: DataFrame, puts: DataFrame, order: list[str]) -> DataFrame:
    """``cells`` (key, column, value) after the puts, which also hold ``order``."""
    fresh = latest_cells(puts, order)
    return cells.join(fresh, ["key", "column"], "left_anti").select("key", "column", "value").unionByName(fresh)


def put_if(cells: DataFrame, puts: DataFrame) -> DataFrame:
    """Conditional puts (key, column, value, if_column, equals), at most one a cell: each takes effect only if
    the row's ``if_column`` holds ``equals`` beforehand. Returns all cells afterwards."""
    held = cells.select("key", F.col("column").alias("if_column"), F.col("value").alias("equals"))
    fresh = puts.join(held, ["key", "if_column", "equals"], "left_semi").select("key", "column", "value")
    return cells.join(fresh, ["key", "column"], "left_anti").select("key", "column", "value").unionByName(fresh)


def put_rows(table: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """``table`` with whole rows replaced by those of the same key, and new ones added."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows)


def page(table: DataFrame, from_key: str = "", size: int = 10, key: str = "key") -> DataFrame:
    """The first ``size`` rows with key >= from_key, in order, with ``next_key``, where the next page begins (null at the end)."""
    ahead = table.where(F.col(key) >= from_key).orderBy(key).limit(size + 1)
    numbered = ahead.withColumn("_n", F.row_number().over(W.orderBy(key)))
    return numbered.withColumn("next_key", F.max(F.when(F.col("_n") > size, F.col(key))).over(W.partitionBy())).where(F.col("_n") <= size).drop("_n")


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """``key, values``: the cells of each row as a map."""
    return cells.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("values"))


class Catalog:
    """Named tables: memory ones are temporary views, persistent ones (names that begin with ``pt-``) are saved."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    @staticmethod
    def persistent(name: str) -> bool:
        return name.startswith("pt-")

    @staticmethod
    def _saved(name: str) -> str:
        """A name that Spark takes for any name, unlike for unlike ones: what is no small letter or digit as ``_`` and its hex bytes."""
        return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "".join(f"_{b:02x}" for b in c.encode()) for c in name)

    @staticmethod
    def _given(saved: str) -> str:
        """The name that ``_saved`` made this of; itself if none."""
        try:
            return re.sub(r"(?:_[0-9a-f]{2})+", lambda m: bytes.fromhex(m[0].replace("_", "")).decode(), saved)
        except UnicodeDecodeError:
            return saved

    def _quoted(self, name: str) -> str:
        return f"`{self.database}`.`{self._saved(name)}`"

    def tables(self) -> list[str]:
        """Names as given, of memory tables too."""
        return sorted(self._given(t.name) for t in self.spark.catalog.listTables(self.database))

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._quoted(name) if self.persistent(name) else f"`{self._saved(name)}`")

    def read(self, name: str) -> DataFrame | None:
        """None for a table that isn't there."""
        if not self.exists(name):
            return None
        return self.spark.table(self._quoted(name) if self.persistent(name) else f"`{self._saved(name)}`")

    def write(self, name: str, df: DataFrame) -> None:
        if self.persistent(name):
            df.write.mode("overwrite").saveAsTable(self._quoted(name))
        else:
            # written, so that it is the table of now, and is computed once
            written(df, "table").createOrReplaceTempView(self._saved(name))

    def rename(self, old: str, new: str) -> None:
        """Fails if ``old`` is missing, ``new`` is there, or a persistent table would become a memory one. A memory
        table that becomes persistent is copied: the memory one stays."""
        if not self.exists(old):
            raise KeyError(old)
        if self.exists(new):
            raise FileExistsError(new)
        if self.persistent(old) and not self.persistent(new):
            raise ValueError("a persistent table can't become a memory table")
        if self.persistent(old):
            self.spark.sql(f"ALTER TABLE {self._quoted(old)} RENAME TO {self._quoted(new)}")
        elif self.persistent(new):
            self.write(new, self.read(old))
        else:
            self.spark.table(f"`{self._saved(old)}`").createOrReplaceTempView(self._saved(new))
            self.delete(old)

    def delete(self, name: str) -> None:
        """Nothing happens if there is no such table."""
        if self.persistent(name):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._quoted(name)}")
        else:
            self.spark.catalog.dropTempView(self._saved(name))


def column_or_null(table: DataFrame, name: str) -> Column:
    return F.col(name) if name in table.columns else F.lit(None).cast("string")
