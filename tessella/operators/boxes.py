"""Boxes of detectors: raw outputs decoded by index arithmetic, and greedy suppression in rounds that run wide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranks
from tessella.session import written


def decode(outputs: DataFrame, frame: str, least: float) -> DataFrame:
    """``frame, box_id, x, y, w, h, score`` of the boxes in raw outputs whose score is ``least`` or more.

    An output is a matrix of ``rows`` x ``columns``, its ``values`` row after
    row. With six columns (and not six rows) each row is a box: two corners,
    score, class. Else each column is a box: its middle and size, then a score
    for each class, of which the best counts. ``box_id`` is the place in the
    output. Nulls, and outputs shorter than they say, give no box.
    """
    by_row = (F.col("columns") == 6) & (F.col("rows") != 6)
    n = F.when(by_row, F.col("rows")).otherwise(F.col("columns"))
    whole = outputs.where((F.size("values") >= F.col("rows") * F.col("columns")) & (n > 0) & (by_row | (F.col("rows") > 4)))
    value = lambda k, at: F.get("values", at).cast("double")
    places = whole.select(frame, "rows", "columns", "values", by_row.alias("_row"), F.explode(F.sequence(F.lit(0), n - 1)).alias("box_id"))
    part = lambda k: F.when(F.col("_row"), value(k, F.col("box_id") * 6 + k)).otherwise(value(k, F.col("box_id") + F.col("columns") * k))
    classes = F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.col("rows") - 1)), lambda k: F.get("values", F.col("box_id") + F.col("columns") * k).cast("double"))
    read = places.select(frame, F.col("box_id").cast("long").alias("box_id"), "_row", *[part(k).alias(f"_{k}") for k in range(4)], F.when(F.col("_row"), part(4)).otherwise(F.array_max(classes)).alias("score"))
    low = lambda a, size: F.when(F.col("_row"), F.col(a)).otherwise(F.col(a) - F.col(size) / 2)
    length = lambda a, size: F.when(F.col("_row"), F.col(size) - F.col(a)).otherwise(F.col(size))
    return read.where(F.col("score") >= least).select(frame, "box_id", low("_0", "_2").alias("x"), low("_1", "_3").alias("y"), length("_0", "_2").alias("w"), length("_1", "_3").alias("h"), "score")


def in_image(boxes: DataFrame, scale: float, left: float, top: float, width: float, height: float) -> DataFrame:
    """Boxes of a scaled and padded picture as shares of the original's width and height (``x0, y0, x1, y1``, 4 digits, cut to 0 and 1)."""
    share = lambda c, pad, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.lit(pad)) / F.lit(scale) / F.lit(size))), 4)
    x, y = F.col("x"), F.col("y")
    corners = {"x0": share(x, left, width), "y0": share(y, top, height), "x1": share(x + F.col("w"), left, width), "y1": share(y + F.col("h"), top, height)}
    return boxes.withColumns(corners).drop("x", "y", "w", "h")


def beaten(conflicts: DataFrame, by: list[str]) -> DataFrame:
    """The rows (``by``, ``id``) that greedy suppression removes; ``conflicts``: ``by``, ``a`` and ``b``, of which ``a`` comes before ``b``.

    In each round what no live row comes before is kept, and what it is in
    conflict with goes. That is what going through the rows one by one keeps,
    in as many rounds as the longest chain of conflicts has links, each a few
    joins by id over all groups at once.
    """
    live, removed = written(conflicts.select(*by, "a", "b"), "conflicts"), []
    while not live.isEmpty():
        tops = live.select(*by, F.col("a").alias("id")).distinct().join(live.select(*by, F.col("b").alias("id")).distinct(), [*by, "id"], "left_anti")
        gone = written(live.join(tops.withColumnRenamed("id", "a"), [*by, "a"]).select(*by, F.col("b").alias("id")).distinct(), "gone")
        removed.append(gone)
        for end in ("a", "b"):
            live = live.join(gone.withColumnRenamed("id", end), [*by, end], "left_anti")
        live = written(live, "conflicts")
    none = conflicts.select(*by, F.col("a").alias("id")).limit(0)
    return reduce(lambda x, y: x.unionByName(y), removed, none)


def overlaps(boxes: DataFrame, by: list[str], threshold: float, iou) -> DataFrame:
    """Pairs of boxes of one group that overlap by more than ``threshold`` (0 or more), the better one (ties: the smaller id) as ``a``.

    Boxes go to the cells of a grid, twice as wide and high as boxes are on
    average, and meet in the first cell both touch.
    """
    mean = boxes.agg(F.avg("w").alias("w"), F.avg("h").alias("h")).first()
    step = {"x": F.lit(2 * mean.w if mean.w and mean.w > 0 else 1.0), "y": F.lit(2 * mean.h if mean.h and mean.h > 0 else 1.0)}
    cell = lambda c, k: F.floor(c / step[k])
    span = lambda k, size: F.sequence(cell(F.col(k), k), F.greatest(cell(F.col(k), k), cell(F.col(k) + F.col(size), k)))
    own = boxes.select(*by, "box_id", "x", "y", "w", "h", "score").withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h")))
    other = own.withColumnsRenamed({c: f"{c}2" for c in ("box_id", "x", "y", "w", "h", "score")})
    before = (F.col("score") > F.col("score2")) | ((F.col("score") == F.col("score2")) & (F.col("box_id") < F.col("box_id2")))
    first = (F.col("_cx") == F.greatest(cell(F.col("x"), "x"), cell(F.col("x2"), "x"))) & (F.col("_cy") == F.greatest(cell(F.col("y"), "y"), cell(F.col("y2"), "y")))
    met = own.join(other, [*by, "_cx", "_cy"]).where(before & first & (iou([F.col(c) for c in "xywh"], [F.col(f"{c}2") for c in "xywh"]) > threshold))
    return met.select(*by, F.col("box_id").alias("a"), F.col("box_id2").alias("b"))


def nearby(df: DataFrame, by: list[str], i: str, strength: Column, distance: int) -> DataFrame:
    """Pairs of rows of one group nearer than ``distance``, the stronger one (ties: the earlier) as ``a``; rows meet by stretches of that length."""
    own = df.select(*by, F.col(i).cast("long").alias("a"), strength.alias("_s")).withColumn("_c", F.floor(F.col("a") / distance))
    other = own.select(*by, F.col("a").alias("b"), F.col("_s").alias("_t"), F.explode(F.array(*[F.col("_c") + k for k in (-1, 0, 1)])).alias("_c"))
    before = (F.col("_s") > F.col("_t")) | ((F.col("_s") == F.col("_t")) & (F.col("a") < F.col("b")))
    return own.join(other, [*by, "_c"]).where(before & (F.abs(F.col("a") - F.col("b")) < distance)).select(*by, "a", "b")


def keep_largest(faces: DataFrame, frame: list[str], least_height: float, most: int, *ties: str) -> DataFrame:
    """Faces (``x0, y0, x1, y1``) at least ``least_height`` high and not without width, the ``most`` largest by area of each frame; ``ties`` settle equal ones."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return ranks.top_k(faces.where((height >= least_height) & (width > 0)), most, frame, (width * height).desc(), *[F.col(c) for c in ties])
