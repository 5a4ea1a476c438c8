"""Interval algebra on axes: every operator works inside an axis key; windows are partitioned by it, joins by it and stretches of it.

Intervals are half-open, ``s <= t < e``. Times may be of any ordered numeric
type; the column names are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, axis: str = "axis", s: str = "s", e: str = "e") -> DataFrame:
    """The union of an axis's intervals; touching ones become one."""
    order = Window.partitionBy(axis).orderBy(s, e)
    reach = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(s) > F.col("_reach"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.select(axis, s, e).withColumn("_reach", reach).withColumn("_island", island)
        .groupBy(axis, "_island").agg(F.min(s).alias(s), F.max(e).alias(e)).select(axis, s, e)
    )


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (e1 > s2) & (s1 < e2)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection, 0 if there is none."""
    length = F.least(e1, e2) - F.greatest(s1, s2)
    return F.greatest(length, length * 0)


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over hull; 0 if the hull is empty."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(F.lit(0.0))


def meet(a: DataFrame, b: DataFrame, axis: str, s1: str, e1: str, s2: str, e2: str) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` on one axis whose intervals overlap; ``b`` has no other columns of ``a`` than the axis.

    The axis is cut into stretches twice as long as intervals are on average,
    and rows are joined by axis and stretch, so a long axis is no task and no
    cross product. An interval goes to every stretch it touches, which makes two
    and a half rows of each on average, however long single ones are. A pair
    comes from the first stretch both touch.
    """
    long = lambda df, s, e: df.agg(F.sum((F.col(e) - F.col(s)).cast("double")).alias("t"), F.count("*").alias("n")).first()
    sizes = [long(a, s1, e1), long(b, s2, e2)]
    n, total = sum(x.n for x in sizes), sum(x.t or 0.0 for x in sizes)
    width = F.lit(2 * total / n if n and total > 0 else 1.0)
    first = lambda s: F.floor(F.col(s) / width)
    dealt = lambda df, s, e: df.withColumn("_at", F.explode(F.sequence(first(s), F.greatest(first(s), F.floor(F.col(e) / width)))))
    met = dealt(a, s1, e1).join(dealt(b, s2, e2), [axis, "_at"])
    return met.where(overlapping(F.col(s1), F.col(e1), F.col(s2), F.col(e2)) & (F.col("_at") == F.greatest(first(s1), first(s2)))).drop("_at")


def subtract(segments: DataFrame, cuts: DataFrame, axis: str = "axis", key: str = "seg", min_length: float = 0) -> DataFrame:
    """What remains of each segment (``axis, key, s, e``) after the cuts (``axis, s, e``); remainders shorter than ``min_length`` go."""
    c = merge(cuts, axis).select(axis, F.col("s").alias("cs"), F.col("e").alias("ce"))
    met = meet(segments.select(axis, key, "s", "e"), c, axis, "s", "e", "cs", "ce")
    whole = segments.join(met.select(axis, key).distinct(), [axis, key], "left_anti").select(axis, key, F.col("s").alias("a"), F.col("e").alias("b"))
    order = Window.partitionBy(axis, key).orderBy("cs")
    placed = met.withColumns({"_n": F.row_number().over(order), "_next": F.lead("cs").over(order)})
    first = placed.where("_n = 1").select(axis, key, F.col("s").alias("a"), F.col("cs").alias("b"))
    rest = placed.select(axis, key, F.col("ce").alias("a"), F.coalesce("_next", "e").alias("b"))
    kept = whole.unionByName(first).unionByName(rest).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") >= min_length))
    return kept.select(axis, key, F.col("a").alias("s"), F.col("b").alias("e"))


def lines_in(clips: DataFrame, lines: DataFrame, axis: str, min_overlap: float) -> DataFrame:
    """Pairs of clips (``clip, s, e``) and lines (``line, ls, le``) that overlap by ``min_overlap`` or half of the line."""
    o = overlap(F.col("s"), F.col("e"), F.col("ls"), F.col("le"))
    pairs = meet(clips, lines, axis, "s", "e", "ls", "le").withColumn("overlap", o)
    return pairs.where((F.col("overlap") >= min_overlap) | (2 * F.col("overlap") >= F.col("le") - F.col("ls")))


def overlap_share(clips: DataFrame, segments: DataFrame, axis: str, key: str) -> DataFrame:
    """Share of each clip that its axis's segments (``ss, se``) cover, counted once for each segment, at most 1."""
    own = clips.select(axis, key, "s", "e")
    met = meet(own, segments.select(axis, "ss", "se"), axis, "s", "e", "ss", "se")
    total = met.groupBy(axis, key).agg(F.sum(overlap(F.col("s"), F.col("e"), F.col("ss"), F.col("se"))).alias("_o"))
    share = F.when(F.col("e") > F.col("s"), F.least(F.lit(1.0), F.coalesce("_o", F.lit(0)) / F.nullif(F.col("e") - F.col("s"), F.lit(0)))).otherwise(F.lit(0.0))
    return own.join(total, [axis, key], "left").select(axis, key, F.round(share, 3).alias("share"))


def section_at(points: DataFrame, sections: DataFrame, axis: str) -> DataFrame:
    """As-of join: the last section (``ss, label``) that starts at or before each point ``t``; null before the first.

    One pass over the union of both in time order, which needs no range join.
    """
    p = points.withColumns({"ss": F.lit(None).cast(sections.schema["ss"].dataType), "label": F.lit(None).cast(sections.schema["label"].dataType), "_side": F.lit(1)})
    q = sections.select(axis, "ss", "label", F.col("ss").alias("t"), F.lit(0).alias("_side"))
    order = Window.partitionBy(axis).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(q, allowMissingColumns=True)
    found = F.last(F.when(F.col("_side") == 0, F.struct("ss", "label")), ignorenulls=True).over(order)
    return both.withColumn("_found", found).where("_side = 1").select(*points.columns, F.col("_found.ss").alias("ss"), F.col("_found.label").alias("label"))


def near_any(points: DataFrame, marks: DataFrame, axis: str, width: int) -> DataFrame:
    """Band semi-join: the points ``t`` with a mark ``m`` nearer than ``width``. Buckets of that width make it an equi-join."""
    p = points.withColumn("_b", F.explode(F.array(*[F.floor(F.col("t") / width) + k for k in (-1, 0, 1)])))
    m = marks.select(axis, "m", F.floor(F.col("m") / width).alias("_b"))
    hit = p.join(m, [axis, "_b"]).where(F.abs(F.col("t") - F.col("m")) < width)
    return hit.select(*points.columns).distinct()


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], min_overlap: float = 0.5) -> DataFrame:
    """Two sources of one interval for each key: the hull where they agree by ``min_overlap`` (both sources named), ``b`` in conflict, else the one there is."""
    j = a.select(*keys, F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("source").alias("o1")).join(
        b.select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("source").alias("o2")), keys, "full_outer"
    )
    agree = overlap_ratio(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")) >= min_overlap
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    pick = lambda x, y, hull: F.when(both & agree, hull).when(F.col("s2").isNotNull(), F.col(y)).otherwise(F.col(x))
    return j.select(
        *keys, pick("s1", "s2", F.least("s1", "s2")).alias("s"), pick("e1", "e2", F.greatest("e1", "e2")).alias("e"),
        pick("o1", "o2", F.concat_ws("+", "o1", "o2")).alias("source"),
    )
