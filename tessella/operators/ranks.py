"""Ranks, pools, density and selection. Ranks over large groups run over ranges of values, so a group is no task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written


#: ``monotonically_increasing_id`` is the partition times 2^33 plus the row in it.
_ROWS = (1 << 33) - 1


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "_pos") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, and ``_n``, the rows of the group; ties have any order.

    The rows are dealt by range over group and order, sorted and numbered
    within each range, and moved on by the rows of the ranges before. So a
    group of any size spreads over as many tasks as it needs, and the rows
    travel once; only one row for each range and group meets in a window.
    All columns of ``df`` are written: leave out those that nobody needs.
    """
    sorted_ = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    table = written(sorted_.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    table = table.withColumns({"_p": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit(_ROWS))})
    sizes = table.groupBy(*by, "_p").agg(F.count("*").alias("_m"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*by)
    before = F.sum("_m").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumns({"_before": F.coalesce(before, F.lit(0)), "_n": F.sum("_m").over(whole)}).drop("_m")
    place = F.col("_row") - F.col("_first") + F.col("_before")
    return _met(table, offsets, [*by, "_p"]).withColumn(name, place).drop("_p", "_row", "_first", "_before")


def _met(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the row of ``small`` that has its keys; null is a key like any other.

    ``small`` is written first: from the size of its files Spark sees whether
    every task can have it, and then ``df`` is not dealt out by the groups, of
    which there may be only a few.
    """
    renamed = written(small.withColumnsRenamed({k: f"_{k}_" for k in keys}), "small")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.join(renamed, condition).drop(*[f"_{k}_" for k in keys])


def _counted(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """``by``, ``_v``, ``_c``, ``_below``, ``_n``: the values of each group, how often each occurs, how many rows come before it, and how many there are.

    Null is a value and comes last. The sums run over ranges of values, so no task holds a group.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = F.col("_v").desc_nulls_last() if descending else F.col("_v").asc_nulls_last()
    table = written(counts.repartitionByRange(*by, order).withColumn("_p", F.spark_partition_id()), "values")
    whole = Window.partitionBy(*by)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(*by, "_p").agg(F.sum("_c").alias("_m"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_m").over(upto(whole.orderBy("_p"))), F.lit(0)), "_n": F.sum("_m").over(whole)}).drop("_m")
    inside = table.withColumn("_in", F.coalesce(F.sum("_c").over(upto(Window.partitionBy("_p", *by).orderBy(order))), F.lit(0)))
    return _met(inside, sums, [*by, "_p"]).select(*by, "_v", "_c", (F.col("_before") + F.col("_in")).alias("_below"), "_n")


def percentile_rank(df: DataFrame, by: list[str], **values: str) -> DataFrame:
    """``df`` with a column for each of ``values`` (its name and the column ranked): the rank from 0 to 1 among the group's values that are not null.

    Ties share the mean position, a single value has 0.5, null stays null.
    Values are counted first (see ``_counted``), and where they are few, each
    task has all of their ranks. ``df`` is read once more for each value, so
    it should be a table.
    """
    for name, value in values.items():
        counted = _counted(df.where(F.col(value).isNotNull()), by, value)
        rank = F.when(F.col("_n") == 1, F.lit(0.5)).otherwise((F.col("_below") + (F.col("_c") - 1) / 2) / F.nullif(F.col("_n") - 1, F.lit(0)))
        found = written(counted.select(*by, F.col("_v"), rank.alias(name)).withColumnsRenamed({k: f"_{k}_" for k in by}), "ranks")
        same = F.col(value) == F.col("_v")
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
        df = df.join(found, same, "left").drop("_v", *[f"_{k}_" for k in by])
    return df


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``by`` and ``name``: the exact median of each group's values that are not null; groups without any have no row. No task holds the values of a group."""
    counted = _counted(df.where(F.col(value).isNotNull()), by, value)
    holds = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col("_v")))
    middle = counted.groupBy(*by).agg(holds(F.expr("(_n - 1) div 2")).alias("_low"), holds(F.expr("_n div 2")).alias("_high"))
    found = middle.select(*by, F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise(0.5 * F.col("_low") + 0.5 * F.col("_high")).alias(name))
    return written(found, "medians")


def index_rank(df: DataFrame, by: list[str], ordinal: list[str], name: str, value: str) -> DataFrame:
    """``df`` with ``name``: the rank of ``value`` from 0 to 1 with ties in the order of ``ordinal``; 0.5 for null and for a single value."""
    table = positions(df, by, [F.col(value).asc_nulls_last(), *[F.col(c) for c in ordinal]])
    n = table.groupBy(*by).agg(F.count(value).alias("_measured"))
    return _met(table, n, by).withColumn(name, _index(value)).drop("_pos", "_n", "_measured")


def _index(value: str) -> Column:
    return F.when(F.col(value).isNull() | (F.col("_measured") <= 1), F.lit(0.5)).otherwise(F.col("_pos") / F.nullif(F.col("_measured") - 1, F.lit(0)))


def index_rank_within(df: DataFrame, by: list[str], ordinal: list[str], name: str, value: str) -> DataFrame:
    """``index_rank`` where a group fits a task anyway: by windows over the group, for which rows that lie together already do not travel."""
    w = Window.partitionBy(*by)
    pos = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), *ordinal)) - 1
    return df.withColumns({"_pos": pos, "_measured": F.count(value).over(w)}).withColumn(name, _index(value)).drop("_pos", "_measured")


def top_share(table: DataFrame, score: str, ordinal: list[str], by: list[str], share: float) -> DataFrame:
    """The best ``share`` of each group (half-even rounding, at least one); ties go to what comes later by ``ordinal``.

    The scores of each group are counted, which tells the last score that gets
    in and how many rows with it; only where not all of these do are they
    ranked (see ``positions``). ``table`` is read three times.
    """
    keep = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share)).cast("long"))
    left = keep - F.col("_below")
    counted = _counted(table, by, score, descending=True)
    cut = written(counted.where((left > 0) & (left <= F.col("_c"))).select(*by, F.col("_v").alias("_cut"), left.alias("_left"), (left == F.col("_c")).alias("_all")), "cuts")
    met = _met(table, cut, by)
    better = F.col(score).isNotNull() & (F.col("_cut").isNull() | (F.col(score) > F.col("_cut")))
    at = F.col(score).eqNullSafe(F.col("_cut"))
    whole = met.where(better | (at & F.col("_all"))).select(*table.columns)
    ties = positions(met.where(at & ~F.col("_all")), by, [F.col(c).desc() for c in ordinal]).where(F.col("_pos") < F.col("_left"))
    return whole.unionByName(ties.select(*table.columns))


def top_k(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= k).drop("_at")


def densest_stretch(df: DataFrame, by: list[str], t: str, window: int) -> DataFrame:
    """For each group the fullest closed window of that length that ends at a start: count, first and last start; the earliest of several."""
    span = Window.partitionBy(*by).orderBy(t).rangeBetween(-window, 0)
    counted = df.select(*by, t).withColumns({"n": F.count("*").over(span), "first": F.min(t).over(span)})
    return top_k(counted, 1, by, F.col("n").desc(), F.col(t)).select(*by, F.col("n").alias("n"), "first", F.col(t).alias("last"))


def crowd(df: DataFrame, by: list[str], t: str, window: int) -> DataFrame:
    """Rows with ``crowd``: how many rows the fullest span of length ``window`` holds that contains the row, itself included.

    Some fullest span starts at a row, so the count of the rows from each row
    on and the greatest of these counts over the starts that reach it suffice.
    """
    order = Window.partitionBy(*by).orderBy(t)
    counted = df.withColumn("_from", F.count("*").over(order.rangeBetween(0, window)))
    return counted.withColumn("crowd", F.max("_from").over(order.rangeBetween(-window, 0))).drop("_from")


def systematic_sample(df: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` evenly spaced rows of each group, first and last included; all rows of a smaller one."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(max(1, count - 1))).cast("int"))
    return placed.where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")
