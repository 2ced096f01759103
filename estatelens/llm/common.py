"""Column hygiene, fixed-size filters and components shared by the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Bits of a filter of row ids that tasks use to skip rows which a later exact join would drop.
FILTER_BITS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast; other columns, however named, take no part."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in columns.items()])


class IdFilter:
    """A fixed number of bits over hashed ids: no false negatives, and never more than FILTER_BITS / 8 bytes.

    It only saves work. With many more ids than bits it passes every row, and the exact join that follows
    decides alone.
    """

    def __init__(self, ids: DataFrame, column: str, bits: int = FILTER_BITS):
        at = F.pmod(F.col(column), F.lit(bits))
        words = (
            ids.select(F.shiftright(at, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, {bits}) & 31 as int))").alias("b"))
            .groupBy("w")
            .agg(F.bit_or("b").alias("b"))
        )
        self.bits, self.words = bits, np.zeros(bits // 32, np.uint32)
        got = words.toPandas()  # at most bits / 32 rows
        self.words[got["w"].to_numpy(int)] = got["b"].to_numpy(np.int64).astype(np.uint32)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = np.mod(ids, self.bits)
        return (self.words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph ``edges(u, v)``; the component is its smallest node.

    Alternating large-star and small-star rounds over written edge tables. A hub's neighbours are never
    gathered: each round is a minimum per node and a join, whose hot keys AQE splits.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    last = None
    while True:
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "cc")
        large.drop()
        now.drop()
        now, seen = after, _signature(after.df)
        if seen == last:
            break
        last = seen
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
