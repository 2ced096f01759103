"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. The token weights of the cells are raked: one margin after
the other is scaled to its target until all fit. A document's calibrated probability is the scale of its cell, times
the one factor that meets the token budget, capped at 1; it is drawn by a hash of its id, so that the draw is the same
on every run and machine. Cells stay in Spark: each sweep is a written table, of one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import only

DIMS = ("source", "lang", "topic")
#: Sweeps stop at this relative error of all margins, or after so many.
TOLERANCE, SWEEPS = 1e-6, 25
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
SEED = 17
_NULL = "\0null"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def label_topics(labels: DataFrame) -> DataFrame:
    """(doc_id, topic) of labelled documents: toxic, junk or clean. The tables have no subjects; labels stand in."""
    labels = only(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null")
    worst = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return worst.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") <= 0, "junk").otherwise("clean").alias("topic"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, share): target shares in proportion to a power of the tokens."""
    margin = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("w")).where("w > 0")
    return margin.crossJoin(F.broadcast(margin.agg(F.sum("w").alias("all")))).select("value", (F.col("w") / F.col("all")).alias("share"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Cells with ``scale``: how much of a cell's tokens the targets want, relative to its tokens.

    Values without a target, or with a target of 0, get scale 0. Target shares are taken relative to the values that
    occur. The last margin is met exactly, the others to TOLERANCE when the targets fit together.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    start = cells.withColumn("scale", F.lit(1.0))
    for dim, t in targets.items():
        seen = t.join(cells.select(F.col(dim).alias("value")).distinct(), "value")
        whole = seen.agg(F.sum("share")).first()[0] or 1.0
        want = seen.select(F.col("value").alias(dim), (F.col("share") / whole * total).alias(f"_{dim}"))
        start = start.join(want, dim, "left").fillna(0.0, [f"_{dim}"])
    kept = [*DIMS, "tokens", *[f"_{d}" for d in targets]]
    now = materialize(start.select(*kept, "scale", F.lit(0.0).alias("_e")), "rake-cells")
    for _ in range(SWEEPS):
        # Each margin is a written table: its plan holds one aggregate and one join, whatever came before.
        for k, dim in enumerate(targets):
            have = now.df.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("scale")).alias("have"), F.max(f"_{dim}").alias("want"))
            ratio = have.select(dim, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("_r"))
            off = F.greatest("_e" if k else F.lit(0.0), F.abs(F.col("_r") - 1))
            after = now.df.join(ratio, dim).select(*kept, (F.col("scale") * F.col("_r")).alias("scale"), off.alias("_e"))
            after = materialize(after, "rake", where=(F.col("scale") > 0) & (F.col("_e") >= TOLERANCE))
            now.drop()
            now = after
        if not now.hits:
            break
    return now.df.select(*DIMS, "tokens", "scale")


def budget_factor(cells: DataFrame, budget: float) -> float:
    """The factor by which capped scales hold ``budget`` of all tokens, by narrowing a grid; each step is one job."""
    total, low, high = cells.agg(F.sum("tokens"), F.min(F.when(F.col("scale") > 0, F.col("scale"))), F.max("scale")).first()
    if not total or not high:
        return 0.0
    low, high = budget / high * 1e-3, 1 / low
    for _ in range(4):
        grid = [low * (high / low) ** (k / 64) for k in range(65)]
        # One sum over a grid of rows: 65 sums would be compiled anew for each grid.
        tried = cells.select("tokens", "scale", F.posexplode(F.lit(grid)).alias("k", "g"))
        sums = tried.groupBy("k").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("scale") * F.col("g"))).alias("s")).orderBy("k").collect()  # 65 rows
        k = next((r["k"] for r in sums if r["s"] >= budget * total), 64)
        low, high = grid[max(0, k - 1)], grid[k]
    return high


def mixed_sample(docs: DataFrame, topics: DataFrame, powers: dict[str, float], budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, scale, probability, kept) of each row of ``docs``.

    ``docs`` has (doc_id, text, source, lang), ``topics`` (doc_id, topic). ``powers`` gives for each dimension the
    power of its token shares that is its target: 1 keeps them, 0 makes them equal. Tokens are words. Nulls form a
    value of their own, documents without a topic are "unlabelled". Texts without words weigh nothing; they share the
    probability of their cell, and 0 where the whole cell has none. Repeated rows are drawn alike; a null doc_id is
    drawn as one more id. Other columns take no part; an empty table gives no rows.
    """
    slim = only(docs, doc_id="long", text="string", source="string", lang="string")
    slim = slim.select("doc_id", "source", "lang", n_words(F.col("text")).alias("n_tokens")).join(topics, "doc_id", "left")
    slim = materialize(slim.withColumn("topic", F.coalesce("topic", F.lit("unlabelled"))), "mix-docs").df
    keyed = slim.select("*", *[F.coalesce(d, F.lit(_NULL)).alias(f"_{d}") for d in DIMS])
    cells = keyed.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMS]).agg(F.sum("n_tokens").alias("tokens"))
    cells = materialize(cells, "mix-cells").df
    raked = rake(cells, {d: tempered(cells, d, p) for d, p in powers.items()})
    factor = budget_factor(raked, budget)
    raked = raked.select(*[F.col(d).alias(f"_{d}") for d in DIMS], "scale", F.least(F.lit(1.0), F.col("scale") * factor).alias("probability"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = keyed.join(raked, [f"_{d}" for d in DIMS])
    return out.select("doc_id", *DIMS, "n_tokens", "scale", "probability", (draw < F.col("probability")).alias("kept"))
