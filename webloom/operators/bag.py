"""Bag: a lazy collection of values, duplicates kept, as a one-column DataFrame.

Methods take Column expressions (a function from Column to Column), which stay in generated code. Plain
Python callables go through the methods named ``*_python``: whole Arrow batches, never a row at a time
across the process border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Expr = Callable[[Column], Column]
#: Groups in which partial results of a fold meet.
FOLD_GROUPS = 1024


class Bag:
    """Rows of one column, ``value``."""

    def __init__(self, df: DataFrame):
        self._df = df.toDF("value")
        self._gone = False

    @property
    def df(self) -> DataFrame:
        if self._gone:
            raise RuntimeError("this collection has been destroyed")
        return self._df

    # sources

    @classmethod
    def parallelize(cls, spark: SparkSession, values: Iterable[str]) -> Bag:
        return cls(spark.createDataFrame([(v,) for v in values], "value string"))

    @classmethod
    def from_table(cls, table: DataFrame, row: Column) -> Bag:
        """One value a row; rows for which ``row`` is null are left out."""
        return cls(table.select(row.alias("value")).where("value is not null"))

    # element-wise

    def map(self, fn: Expr) -> Bag:
        return Bag(self.df.select(fn(F.col("value"))))

    def flat_map(self, fn: Expr) -> Bag:
        """``fn`` gives an array; a null or empty one gives nothing."""
        return Bag(self.df.select(F.explode(fn(F.col("value")))))

    def map_to_pair(self, key: Expr, value: Expr):
        """Values whose key is null give nothing."""
        return Pairs(self.df.select(key(F.col("value")).alias("k"), value(F.col("value")).alias("v")).where("k is not null"))

    def flat_map_to_pair(self, fn: Expr):
        """``fn`` gives an array of structs of two fields."""
        return Pairs(self.df.select(F.inline(fn(F.col("value")))))

    def filter(self, keep: Expr) -> Bag:
        return Bag(self.df.where(keep(F.col("value"))))

    def sample(self, fraction: float, seed: int | None = None) -> Bag:
        return Bag(self.df.sample(False, fraction, seed))

    def map_partitions(self, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str = "string") -> Bag:
        """``fn`` is called once a partition with its batches."""
        return Bag(self.df.mapInPandas(fn, f"value {kind}"))

    def flat_map_python(self, fn: Callable[[str], Iterable | None], kind: str = "string", on_error: str = "raise") -> Bag:
        """A Python function of one value; with ``on_error="skip"`` values for which it fails give nothing."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for v in b["value"]:
                    try:
                        out.extend(fn(v) or ())
                    except Exception:
                        if on_error != "skip":
                            raise
                yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

        return self.map_partitions(run, kind)

    # whole-collection

    def fold(self, zero, merge: Callable[[Column, Column], Column], kind: str = "string"):
        """Python value of folding all values from ``zero``: pieces of partitions first, then their results, which
        are folded from ``zero`` again; so zero should be neutral and ``merge`` associative and commutative.

        A piece is an Arrow batch, made a list where it is: no value is shuffled. The pieces' results meet in
        ``FOLD_GROUPS`` groups and only those groups' in one task.
        """
        start = F.lit(zero).cast(kind)

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays([0, b.num_rows], b.column(0)).cast(pa.list_(b.column(0).type))], names=["values"])

        pieces = self.df.select(F.col("value").cast(kind).alias("value")).mapInArrow(listed, f"values array<{kind}>")
        folded = pieces.select(F.aggregate("values", start, merge).alias("v"), F.pmod(F.monotonically_increasing_id(), F.lit(FOLD_GROUPS)).alias("g"))
        rest = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), c[0], merge)
        groups = folded.groupBy("g").agg(F.collect_list("v").alias("all")).where(F.size("all") > 0).select(rest(F.col("all")).alias("v"))
        return groups.agg(F.aggregate(F.collect_list("v"), start, merge).alias("v")).first()["v"]

    def aggregate(self, value: Column) -> DataFrame:
        """A built-in aggregate over ``value``: partial in every task, then final."""
        return self.df.agg(value)

    def count(self) -> int:
        return self.df.count()

    def distinct(self) -> Bag:
        return Bag(self.df.distinct())

    def group_by(self, key: Expr, separator: str = ","):
        """(key, its values in order, joined)."""
        grouped = self.df.groupBy(key(F.col("value")).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("value")), separator).alias("v"))
        return Pairs(grouped)

    def intersection(self, other: Bag) -> Bag:
        return Bag(self.df.intersect(other.df))

    def union(self, other: Bag) -> Bag:
        return Bag(self.df.unionAll(other.df))

    def subtract(self, other: Bag) -> Bag:
        return Bag(self.df.exceptAll(other.df))

    # results

    def collect(self) -> list:
        return [r.value for r in self.df.collect()]

    def take(self, n: int) -> list:
        return [r.value for r in self.df.limit(n).collect()]

    def save_as_table(self, name: str, mode: str = "overwrite") -> None:
        self.df.write.mode(mode).saveAsTable(name)

    def destroy(self) -> None:
        self._df.unpersist()
        self._gone = True


class Pairs:
    """Rows of two columns, ``k`` and ``v``; a key may have many rows."""

    def __init__(self, df: DataFrame):
        self._df = df.toDF("k", "v")
        self._gone = False

    @property
    def df(self) -> DataFrame:
        if self._gone:
            raise RuntimeError("this collection has been destroyed")
        return self._df

    def flat_map(self, fn: Callable[[Column, Column], Column]) -> Bag:
        return Bag(self.df.select(F.explode(fn(F.col("k"), F.col("v")))))

    def flat_map_to_pair(self, fn: Callable[[Column, Column], Column]) -> Pairs:
        return Pairs(self.df.select(F.inline(fn(F.col("k"), F.col("v")))))

    def fold_by_key(self, value: Column) -> Pairs:
        """One row a key, by a built-in aggregate of ``v``: summed in every task before the shuffle."""
        return Pairs(self.df.groupBy("k").agg(value.alias("v")))

    def fold_by_key_ordered(self, zero: Column, merge: Callable[[Column, Column], Column]) -> Pairs:
        """One row a key, by folding its values in order; for folds that no built-in aggregate expresses."""
        return Pairs(self.df.groupBy("k").agg(F.aggregate(F.array_sort(F.collect_list("v")), zero, merge).alias("v")))

    def join(self, other: Pairs) -> DataFrame:
        """Inner join: ``k, v, w``, a row for each combination of the values of a key."""
        return self.df.join(other.df.withColumnRenamed("v", "w"), "k")

    def join_text(self, other: Pairs, separator: str = ",") -> Pairs:
        return Pairs(self.join(other).select("k", F.concat_ws(separator, "v", "w")))

    def cogroup(self, other: Pairs) -> Pairs:
        """For each key of either side ``[x1,x2],[y1,y2]``, values in order."""
        of = lambda side, name: side.df.groupBy("k").agg(F.array_sort(F.collect_list(F.col("v").cast("string"))).alias(name))
        both = of(self, "a").join(of(other, "b"), "k", "full_outer")
        text = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
        return Pairs(both.select("k", F.concat(text("a"), F.lit(","), text("b"))))

    def count_keys(self) -> int:
        return self.df.select("k").distinct().count()

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def rows(self) -> DataFrame:
        """One row a key, with all its values in order."""
        return self.df.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v"))

    def save_as_table(self, name: str, mode: str = "overwrite") -> None:
        self.rows().write.mode(mode).saveAsTable(name)

    def destroy(self) -> None:
        self._df.unpersist()
        self._gone = True
