"""Declaring queries: a function of the tables, with the SQL that must give the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telar.session import table


class Tables:
    """Lazy access to the tables of one directory: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(Tables(spark, sf_dir))

            run.__doc__ = build.__doc__
            self.QUERIES[name] = run
            if sql:
                self.ORACLE[name] = sql
            return build

        return add
