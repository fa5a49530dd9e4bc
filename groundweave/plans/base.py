"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundweave.plans.fixtures import fixture, with_fixtures


class Tables:
    """Given and derived tables by name, as they stand or as a stream of their files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)

    def stream(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name, stream=True)


class Registry:
    """Queries by name, each a function of the tables, and their SQL where it has a form."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[f.__name__] = with_fixtures(sql)
            return f

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order in the last digits. A whole number stays as it is without the way by a decimal."""

    def near(c: str):
        whole = F.floor(F.col(f"`{c}`")).cast("double")
        return F.when(F.col(f"`{c}`") == whole, whole).otherwise(F.round(f"`{c}`", digits)).alias(c)

    return df.select(*(near(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))
