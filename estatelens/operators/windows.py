"""Per-group ordering operators that stay distributed when one group is very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LARGE_GROUP = 100_000  # rows of a group that one task may order


def last_per_file(history: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` ratings of each file. Spark trims groups map-side (window group limit)."""
    w = Window.partitionBy("repo", "path").orderBy(F.desc("recorded_at"), F.desc("seq"))
    return history.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def trend_rows(trend: DataFrame, n: int = 50, newest: bool = False) -> DataFrame:
    """Oldest (reference behaviour) or newest ``n`` trend rows per repository."""
    order = [F.desc("recorded_at"), F.desc("seq")] if newest else [F.col("recorded_at"), F.col("seq")]
    w = Window.partitionBy("repo").orderBy(*order)
    return trend.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def previous_row(df: DataFrame, keys: list[str], time: str, seq: str, cols: list[str], bucket: str = "1 hour") -> DataFrame:
    """Add ``prev``, a struct of ``cols`` of the row before in each key's (time, seq) order.

    Time buckets keep a key with a huge history out of a single task: rows are compared inside
    (key, bucket), and only one row per bucket takes part in finding the value before it.
    """
    value = F.struct(*cols)
    h = df.withColumn("_b", F.window(F.col(time).cast("timestamp"), bucket)["start"])
    inside = h.withColumn("_in", F.lag(value).over(Window.partitionBy(*keys, "_b").orderBy(time, seq)))
    last = h.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(time, seq)).alias("_last"))
    before = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    out = inside.join(before, [*keys, "_b"], "left")
    return out.withColumn("prev", F.coalesce("_in", "_before")).drop("_b", "_in", "_before")


def rating_deltas(history: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Change of a file's rating against its previous analysis."""
    out = previous_row(history, ["repo", "path"], "recorded_at", "seq", ["rating"], bucket)
    return out.withColumn("previous", F.col("prev.rating")).withColumn("delta", F.col("rating") - F.col("previous")).drop("prev")


def trend_bounds(trend: DataFrame) -> DataFrame:
    """Axis range of a rating series per repository: half a point around it, inside [0, 10]."""
    return trend.groupBy("repo").agg(
        F.greatest(F.lit(0.0), F.min("rating") - 0.5).alias("y_min"),
        F.least(F.lit(10.0), F.max("rating") + 0.5).alias("y_max"),
        F.count(F.lit(1)).alias("points"),
    ).filter("points >= 2")


def trend_direction(history: DataFrame, n: int = 20) -> DataFrame:
    """Direction of each file's last ``n`` ratings: newest against oldest, for files with two or more."""
    t = F.struct("recorded_at", "seq")
    agg = last_per_file(history, n).groupBy("repo", "path").agg(
        F.max_by("rating", t).alias("newest"), F.min_by("rating", t).alias("oldest"), F.count(F.lit(1)).alias("points")
    )
    d = F.col("newest") - F.col("oldest")
    return agg.filter("points > 1").withColumn(
        "direction", F.when(d > 0, "improving").when(d < 0, "declining").otherwise("stable")
    )


def _slices(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned by (group, order), with the slice number ``_p``.

    A group that holds a large share of all rows is cut into several slices this way. Written once,
    because range bounds are sampled and must not be drawn twice.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*group, *order]])
    return materialize(ranged.withColumn("_p", F.spark_partition_id()), "slices").df


def position_in_group(df: DataFrame, group: list[str], order: list[str] | str, name: str) -> DataFrame:
    """1-based position of each row in its group: numbered per slice, shifted by the slices before."""
    order = [order] if isinstance(order, str) else order
    cut = _slices(df, group, order)
    w = Window.partitionBy(*group, "_p").orderBy(*order)
    counts = cut.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        cut.withColumn("_i", F.row_number().over(w))
        .join(shift, [*group, "_p"])
        .withColumn(name, F.col("_o") + F.col("_i"))
        .drop("_p", "_i", "_o")
    )


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to each row in the order of a unique column: summed per slice, shifted by the slices before."""
    cut = _slices(df, [], [order])
    upto = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per slice.
    sums = cut.groupBy("_p").agg(F.sum(value).alias("_n"))
    shift = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return cut.withColumn("_i", F.sum(value).over(upto)).join(F.broadcast(shift), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def next_in_group(df: DataFrame, group: list[str], order: list[str], value: str, name: str, counted: DataFrame | None = None) -> DataFrame:
    """Value of the next row of the group.

    Groups go through one window, so the rows are shuffled once. Those of a first column with more than LARGE_GROUP rows
    are cut into slices: inside a slice the next row, else the first value of the next slice. ``counted`` may hold that
    column for the same rows or more, where counting ``df`` costs more.
    """
    sizes = (df if counted is None else counted).groupBy(group[0]).agg(F.count(F.lit(1)).alias("_n"))
    # Fewer keys than rows / LARGE_GROUP.
    large = materialize(sizes.filter(F.col("_n") > LARGE_GROUP).select(group[0]), "large")
    w = Window.partitionBy(*group).orderBy(*order)
    if not large.rows:
        large.drop()
        return df.withColumn(name, F.lead(value).over(w))
    rest = df.join(large.df, group[0], "left_anti").select(*df.columns).withColumn(name, F.lead(value).over(w))
    return rest.unionByName(_next_in_slices(df.join(large.df, group[0], "left_semi").select(*df.columns), group, order, value, name))


def _next_in_slices(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    cut = _slices(df, group, order)
    inside = F.lead(value).over(Window.partitionBy(*group, "_p").orderBy(*order))
    first = cut.groupBy(*group, "_p").agg(F.min_by(value, F.struct(*order)).alias("_f"))
    after = first.select(*group, "_p", F.lead("_f").over(Window.partitionBy(*group).orderBy("_p")).alias("_after"))
    # Only groups cut into several slices have a next slice; usually none or few.
    after = after.filter("_after IS NOT NULL")
    out = cut.withColumn("_in", inside).join(after, [*group, "_p"], "left")
    return out.withColumn(name, F.coalesce("_in", "_after")).drop("_p", "_in", "_after")


def uncovered_ranges(lines: DataFrame, shown: int | None = 10) -> DataFrame:
    """Uncovered line numbers as text such as ``1-3, 5``: the first ``shown`` ranges, or all where it is None.

    Range starts and ends are the lines without a neighbour before or after them; the i-th start
    belongs to the i-th end. No file's lines are gathered in one task.
    Input: (path, line), already only the uncovered ones.
    """
    # Each line tells itself and both neighbours that it exists: one shuffle on (path, line).
    told = F.array(*[F.struct((F.col("line") + d).alias("line"), F.lit(d).alias("d")) for d in (0, 1, -1)])
    marks = lines.select("path", F.explode(told).alias("m")).groupBy("path", F.col("m.line").alias("line")).agg(
        *[F.max(F.col("m.d") == d).alias(c) for d, c in ((0, "here"), (1, "has_prev"), (-1, "has_next"))]
    )
    marks = materialize(marks.filter("here").drop("here"), "ranges").df
    w = Window.partitionBy("path").orderBy("line")
    top = lambda cond, c: marks.filter(cond).select("path", F.col("line").alias(c), F.row_number().over(w).alias("rn")).filter(F.lit(True) if shown is None else F.col("rn") <= shown)
    first = top("NOT has_prev", "a").join(top("NOT has_next", "b"), ["path", "rn"])
    item = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(
        F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))
    )
    text = first.groupBy("path").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("t")))), lambda x: x["t"]), ", "
        ).alias("ranges")
    )
    counts = marks.groupBy("path").agg(F.count_if(~F.col("has_prev")).alias("n_ranges"), F.count(F.lit(1)).alias("n_lines"))
    more = F.lit("") if shown is None else F.when(
        F.col("n_ranges") > shown, F.concat(F.lit(" (+"), (F.col("n_ranges") - shown).cast("string"), F.lit(" more)"))
    ).otherwise("")
    return text.join(counts, "path").select(
        "path", "n_lines", "n_ranges", F.concat("ranges", more).alias("ranges")
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint row."""
    cols = checkpoints.columns
    return checkpoints.agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("c")).select(
        *[F.col(f"c.{c}").alias(c) for c in cols]
    )
