"""Jobs: a function of an engine and arguments, and what it has to say."""

from __future__ import annotations

import importlib
import traceback
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from webloom.operators import Bag
from webloom.sources.kv import Catalog


class Engine:
    """What a job gets: sources, the tables, and a place for output."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self._said = spark, Catalog(spark), []

    def parallelize(self, values: Iterable[str]) -> Bag:
        return Bag.parallelize(self.spark, values)

    def from_table(self, table: str | DataFrame, row: Column) -> Bag:
        df = self.tables.read(table) if isinstance(table, str) else table
        if df is None:
            raise KeyError(table)
        return Bag.from_table(df, row)

    def output(self, text: str) -> None:
        self._said.append(text)

    def set_concurrency(self, n: int) -> None:
        """Shuffle partitions of what is planned from now on."""
        self.spark.conf.set("spark.sql.shuffle.partitions", str(n))

    @property
    def said(self) -> str:
        return "".join(self._said) or "No output"


def submit(spark: SparkSession, job: str | Callable[[Engine, list[str]], None], args: list[str] | None = None) -> str:
    """Runs ``job`` (a function, or ``module:function``) and returns its output; failures raise with its stack trace."""
    if isinstance(job, str):
        module, _, name = job.partition(":")
        job = getattr(importlib.import_module(module), name or "run")
    engine = Engine(spark)
    try:
        job(engine, list(args or []))
    except Exception as e:
        raise RuntimeError(traceback.format_exc()) from e
    return engine.said
