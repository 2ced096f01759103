"""Adapted input tables of one data folder, written once per session and shared by the queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as C
from ..session import materialize
from ..sources import adapters as A


class Tables:
    """Lazily derived tables. Graph inputs are materialised because the loops read them many times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return A.table(self.spark, self.sf, name)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = materialize(make(), name).df
        return self._kept[name]

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: A.nodes(self.spark, self.sf))

    @property
    def local(self) -> DataFrame:
        return self._once("local", lambda: A.edges(self.spark, self.sf))

    @property
    def sparse(self) -> DataFrame:
        return self._once("sparse", lambda: A.sparse_edges(self.spark, self.sf))

    @property
    def cross(self) -> DataFrame:
        return self._once("cross", lambda: A.edges(self.spark, self.sf, ()))

    @property
    def acyclic(self) -> DataFrame:
        return self._once("acyclic", lambda: A.acyclic_edges(self.spark, self.sf))

    @property
    def components(self) -> DataFrame:
        return self._once("components", lambda: C.strong_components(self.sparse))

    @property
    def violations(self) -> DataFrame:
        return A.file_violations(self.spark, self.sf)

    @property
    def rated(self) -> DataFrame:
        return A.rated_files(self.spark, self.sf)

    @property
    def files(self) -> DataFrame:
        return A.files(self.spark, self.sf)

    @property
    def history(self) -> DataFrame:
        return A.history(self.spark, self.sf)

    @property
    def changes(self) -> DataFrame:
        return A.changes(self.spark, self.sf)

    @property
    def corpus(self) -> DataFrame:
        return A.corpus(self.spark, self.sf)

    @property
    def roots(self) -> DataFrame:
        """Every file as a root."""
        return self.nodes.select(F.col("id").alias("root"))

    @property
    def worst(self) -> DataFrame:
        """The worst-rated file of each repository: (repo, worst)."""
        return self.nodes.groupBy("repo").agg(F.min_by("id", F.struct("rating", "id")).alias("worst"))

    def snapshot(self, status: str) -> tuple[DataFrame, DataFrame]:
        if f"n{status}" not in self._kept:
            both = self._once("snap", lambda: A.snapshot_edges(self.spark, self.sf))
            e = self._kept[f"e{status}"] = both.filter(F.col("l_linestatus") == status).drop("l_linestatus")
            self._once(f"n{status}", lambda: A.snapshot_nodes(self.spark, self.sf, status, e))
        return self._kept[f"n{status}"], self._kept[f"e{status}"]


@lru_cache(maxsize=8)
def _tables(app_id: str, sf_dir: str, spark: SparkSession) -> Tables:
    return Tables(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return _tables(spark.sparkContext.applicationId, sf_dir, spark)


class Catalogue:
    """Queries by name, each with its SQL check where one exists."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep
