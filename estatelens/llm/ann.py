"""Approximate nearest neighbours by inner product: a random-projection forest with exact reranking.

A vector x is mapped to ``(x, sqrt(M^2 - |x|^2))`` with M the largest norm, which makes the largest inner product
the smallest angle. The trees are grown on a bounded sample (``SAMPLE`` different vectors with the lowest hashes):
each node splits by the hyperplane between two of its vectors at the median. Every different vector is then indexed:
it falls into one leaf of each tree. A query keeps one priority queue over the nodes of all trees, ordered by the
sum of the squared margins of the planes on the wrong side of which a node lies, and opens leaves until they hold
enough candidates. Candidates of the opened leaves are reranked by the exact inner product, in double precision, of the
original vectors.

How many candidates are enough is fitted, not fixed: for ``PROBES`` query vectors the exact neighbours among all
vectors are found by one scan, and the search is as long as it takes to reach ``TARGET`` of them. It follows the data:
short where vectors have close neighbours, long where they have none.

Equal vectors are indexed once with their ``K + 1`` smallest ids; larger ids of the same vector rank behind these for
every query. Leaves meet their queries in bounded blocks: large leaves, and leaves with many queries, are split.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import kernel as KN

K = 20
TREES = 24
SAMPLE = 16_384
LEAF = 24
#: Query vectors whose exact neighbours fit the length of the search, and the share of these neighbours to be reached.
PROBES = 64
TARGET = 0.96
#: Least candidates, counted once for each tree that offers them: up to 200 vectors are searched whole.
SEARCH = 200 * TREES
BLOCK = 4096


class Tree:
    """One tree as arrays: planes and offsets of inner nodes, children, and the leaf number of leaves."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        self.planes, self.offsets, self.children, self.leaf, self.n_leaves = [], [], [], [], 0
        self._grow(x, np.arange(len(x)), rng)
        d = x.shape[1] if x.ndim == 2 else 1
        self.planes = np.array([p if p is not None else np.zeros(d) for p in self.planes], np.float32)
        self.offsets, self.children, self.leaf = np.array(self.offsets), np.array(self.children), np.array(self.leaf)

    def _grow(self, x: np.ndarray, rows: np.ndarray, rng) -> int:
        node = len(self.planes)
        for column, empty in ((self.planes, None), (self.offsets, 0.0), (self.children, (0, 0)), (self.leaf, -1)):
            column.append(empty)
        plane = None
        if len(rows) > LEAF:
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = a / max(np.linalg.norm(a), 1e-12) - b / max(np.linalg.norm(b), 1e-12)
            size = np.linalg.norm(plane)
            side = x[rows] @ plane
            middle = np.median(side)
            right = side > middle
            if size < 1e-9 or right.all() or not right.any():
                plane = None
        if plane is None:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        self.planes[node], self.offsets[node] = plane / size, middle / size
        self.children[node] = (self._grow(x, rows[~right], rng), self._grow(x, rows[right], rng))
        return node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]
            at[inner] = self.children[node, right.astype(int)]


class Forest:
    """Trees over vectors of norm ``top`` at most: given ones, or ``trees`` of them grown here on ``sample``."""

    def __init__(self, sample: np.ndarray, top: float, trees: int | list[Tree]):
        self.top = top
        self.trees = trees if isinstance(trees, list) else [Tree(self.lift(sample), np.random.default_rng(k)) for k in range(trees)]

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
        return np.concatenate([x, rest], axis=1)

    def opened(self, query: np.ndarray, counts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(tree, leaf) pairs that hold vectors, in the order of the shared queue."""
        q = np.r_[query / max(np.linalg.norm(query), 1e-300), 0.0]  # a query's length does not change the order
        sides = [t.planes @ q - t.offsets for t in self.trees]
        queue = [(0.0, k, 0) for k in range(len(self.trees))]
        while queue:
            cost, k, node = heapq.heappop(queue)
            t = self.trees[k]
            while t.leaf[node] < 0:
                side = sides[k][node]
                near, far = (1, 0) if side > 0 else (0, 1)
                heapq.heappush(queue, (cost + side * side, k, int(t.children[node][far])))
                node = t.children[node][near]
            leaf = int(t.leaf[node])
            if counts[k][leaf]:
                yield k, leaf

    def search(self, query: np.ndarray, counts: list[np.ndarray], enough: int) -> list[tuple[int, int]]:
        """The first pairs of the queue that hold ``enough`` vectors together."""
        found, have = [], 0
        for k, leaf in self.opened(query, counts):
            found.append((k, leaf))
            have += counts[k][leaf]
            if have >= enough:
                break
        return found

    def reached(self, query: np.ndarray, near: np.ndarray, counts: list[np.ndarray]) -> list[int]:
        """For each row of ``near``, the vectors that the search has opened once it meets the row."""
        where: dict[tuple[int, int], list[int]] = {}
        for k, t in enumerate(self.trees):
            for i, leaf in enumerate(t.leaves(self.lift(near))):
                where.setdefault((k, int(leaf)), []).append(i)
        met, have = {}, 0
        for pair in self.opened(query, counts):
            have += int(counts[pair[0]][pair[1]])
            for i in where.get(pair, ()):
                met.setdefault(i, have)
            if len(met) == len(near):
                break
        return list(met.values())


def _grow(sample, forest):
    """One task a tree; only its finished arrays go back."""

    def run(batches):
        for b in batches:
            seeds = b.column("id").to_pylist()
            trees = [pickle.dumps(Tree(forest.lift(sample.value), np.random.default_rng(k))) for k in seeds]
            yield pa.record_batch({"id": pa.array(seeds, pa.int64()), "tree": pa.array(trees, pa.binary())})

    return run


def _exact(probes):
    """Best vectors of a partition for each probe, by inner product; what is kept does not grow with the rows."""

    def run(batches):
        names, q = probes.value
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for b in batches:
            if not b.num_rows:
                continue
            keys, scores = b.column("key").to_numpy(), _matrix(b.column("v")) @ q.T
            for i, own in enumerate(names):
                at = np.argsort(-scores[:, i], kind="stable")[: K + 1]
                best[i] = heapq.nlargest(K, best[i] + [(s, k) for s, k in zip(scores[at, i].tolist(), keys[at].tolist(), strict=True) if k != own])
        flat = [(own, k, s) for own, rows in zip(names, best, strict=True) for s, k in rows]
        yield pa.record_batch({"probe": pa.array([f[0] for f in flat], pa.int64()), "key": pa.array([f[1] for f in flat], pa.int64()), "score": pa.array([f[2] for f in flat], pa.float64())})

    return run


def _reached(forest, counts):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        met: list[int] = []
        if left.num_rows and right.num_rows:
            met = forest.value.reached(_matrix(left.column("v"))[0], _matrix(right.column("v")), counts)
        return pa.table({"opened": pa.array(met, pa.int64())})

    return run


def _matrix(column) -> np.ndarray:
    """The rows of a list column; all are of one length and hold no nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _route(forest):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = forest.value.lift(_matrix(b.column("v")))
                for k, t in enumerate(forest.value.trees):
                    yield pa.record_batch({"key": b.column("key"), "tree": np.full(len(x), k, np.int32), "leaf": t.leaves(x).astype(np.int32)})

    return run


def _search(forest, counts, enough):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for i, q in enumerate(_matrix(b.column("v"))):
                found = forest.value.search(q, counts, enough)
                if found:
                    tree, leaf = np.array(found, np.int32).T
                    yield pa.record_batch({"query": pa.array([b.column("key")[i].as_py()] * len(found), pa.int64()), "tree": tree, "leaf": leaf})

    return run


def _rerank(left: pa.Table, right: pa.Table) -> pa.Table:
    """Best candidates of each query of a block among the members of a block."""
    out: dict[str, list] = {"query": [], "key": [], "score": []}
    if left.num_rows and right.num_rows:
        x, keys, low = _matrix(right.column("v")), right.column("key").to_numpy(), right.column("low").to_numpy()
        for name, q in zip(left.column("query").to_pylist(), _matrix(left.column("v")), strict=True):
            score = (x * q).sum(axis=1)  # one fixed order of summation, so that equal vectors score equally
            best = np.lexsort((low, -score))[: K + 1]
            out["query"] += [name] * len(best)
            out["key"] += keys[best].tolist()
            out["score"] += score[best].tolist()
    return pa.table(out, pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())]))


def nearest(vectors: DataFrame, every: int = K, trees: int = TREES, search: int | None = None, k: int = K, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query in ``vectors(vec_id, embedding)``.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id; the score
    is the inner product in double precision; ties go to the smaller vec_id. Rows with a null id, and vectors that are
    null, empty, zero or hold a null, infinite or NaN component, take no part, nor do vectors of another than the most
    common length. Repeated rows count once; an id with several vectors counts with its best score. Other columns take
    no part. Without valid rows there is no result. k + 1 ids of a vector are kept, and K bounds k.

    ``search`` fixes the candidates of a query instead of fitting them. ``report`` receives the number of different
    vectors, the candidates a query opens, counted once for each tree, and the share of the probes' neighbours reached.
    """
    if k > K:
        raise ValueError(f"k is at most {K}")
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    rows = v.join(F.broadcast(common), F.size("v") == F.col("d")).select("vec_id", "v")
    lowest = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.distinct().withColumn("_r", F.row_number().over(lowest)).where(F.col("_r") <= K + 1)
    kept = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most K + 1 ids
    kept = kept.select("v", "ids", F.col("ids")[0].alias("key"))
    # An id may have several vectors: number them apart.
    again = Window.partitionBy("key").orderBy("v")
    kept = kept.withColumn("key", F.xxhash64("key", F.row_number().over(again)))
    kept = materialize(kept.withColumn("low", F.col("ids")[0]), "ann-vectors")
    ask = rows.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    ask = materialize(ask.join(kept.df.select("key", F.col("v").alias("q")), "q").select("query_id", F.col("key").alias("query"), F.col("q").alias("v")), "ann-queries")
    result = "query_id long, rank int, vec_id long, score double"
    if not ask.rows:
        return spark.createDataFrame([], result)
    sample = kept.df.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()  # bounded
    top = kept.df.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    grown = _forest(spark, _matrix(sample.column("v")), top, trees)
    forest = spark.sparkContext.broadcast(grown)  # trees * 2 * SAMPLE / LEAF planes at most
    routed = materialize(kept.df.select("key", "v").mapInArrow(_route(forest), "key long, tree int, leaf int"), "ann-leaves")
    leaves = routed.df
    sizes = leaves.groupBy("tree", "leaf").count()
    counts = [np.zeros(t.n_leaves, np.int64) for t in grown.trees]
    for r in sizes.collect():  # one row for each leaf of the bounded forest
        counts[r["tree"]][r["leaf"]] = r["count"]
    asked = ask.df.dropDuplicates(["query"]).select(F.col("query").alias("key"), "v")
    enough, share = (search, None) if search else _fitted(kept.df, asked, forest, counts)
    if report is not None:
        report.update(vectors=kept.rows, opened=enough, recall=share)
    spread = asked.repartition("key")
    found = materialize(spread.mapInArrow(_search(forest, counts, enough), "query long, tree int, leaf int"), "ann-probes")
    probes = found.df
    load = probes.groupBy("tree", "leaf").count().withColumnRenamed("count", "n_queries")
    split = sizes.join(load, ["tree", "leaf"]).select("tree", "leaf", F.ceil(F.col("count") / BLOCK).alias("nb"), F.ceil(F.col("n_queries") / BLOCK).alias("nq"))
    blocks = materialize(split, "ann-split")
    split = blocks.df
    ways = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    member = leaves.join(split, ["tree", "leaf"]).withColumn("b", F.pmod("key", "nb")).withColumn("qb", ways("nq"))
    member = member.join(kept.df.select("key", "v", "low"), "key").select("tree", "leaf", "b", "qb", "key", "v", "low")
    called = probes.join(split, ["tree", "leaf"]).withColumn("qb", F.pmod("query", "nq")).withColumn("b", ways("nb"))
    called = called.join(asked.withColumnRenamed("key", "query"), "query").select("tree", "leaf", "b", "qb", "query", "v")
    met = called.groupBy("tree", "leaf", "b", "qb").cogroup(member.groupBy("tree", "leaf", "b", "qb")).applyInArrow(_rerank, "query long, key long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low", "key")
    near = met.groupBy("query", "key").agg(F.max("score").alias("score")).join(kept.df.select("key", "low", "ids"), "key")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= K + 1)
    pairs = ask.df.select("query_id", "query").join(near, "query").select("query_id", F.explode("ids").alias("vec_id"), "score")
    pairs = pairs.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    out = materialize(ranked.select("query_id", "rank", "vec_id", "score"), "ann-nearest").df  # k rows a query
    for t in (kept, ask, routed, found, blocks):
        t.drop()
    forest.destroy()
    return out


def _forest(spark: SparkSession, sample: np.ndarray, top: float, trees: int) -> Forest:
    """Trees grown side by side in tasks on the bounded sample."""
    bare, shared = Forest(sample, top, []), spark.sparkContext.broadcast(sample)
    got = spark.range(0, trees, 1, trees).mapInArrow(_grow(shared, bare), "id long, tree binary").toArrow()
    shared.destroy()
    grown = dict(zip(got.column("id").to_pylist(), got.column("tree").to_pylist(), strict=True))
    return Forest(sample, top, [pickle.loads(grown[k]) for k in range(trees)])


def _fitted(vectors: DataFrame, asked: DataFrame, forest, counts: list[np.ndarray]) -> tuple[int, float]:
    """Candidates after which a search has met TARGET of the exact neighbours of the probes, and the share met."""
    spark = vectors.sparkSession
    chosen = asked.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(PROBES).toArrow()  # bounded
    names = chosen.column("key").to_pylist()
    probes = spark.sparkContext.broadcast((names, _matrix(chosen.column("v"))))
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "key")
    near = vectors.select("key", "v").mapInArrow(_exact(probes), "probe long, key long, score double")
    near = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= K).select("probe", "key")
    near = near.join(vectors.select("key", "v"), "key").select("probe", "v")  # PROBES * K rows
    them = spark.createDataFrame(chosen).select(F.col("key").alias("probe"), "v")
    met = them.groupBy("probe").cogroup(near.groupBy("probe")).applyInArrow(_reached(forest, counts), "opened long")
    opened = sorted(r["opened"] for r in met.collect())  # at most PROBES * K
    probes.destroy()
    if not opened:
        return SEARCH, 1.0
    enough = max(SEARCH, opened[min(len(opened), int(np.ceil(TARGET * len(opened)))) - 1])
    return enough, sum(n <= enough for n in opened) / len(opened)
