"""Time series inside groups: runs, boundaries, sections, peaks, tempo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import boxes


def runs(df: DataFrame, by: list[str], i: str, max_gap: int = 0) -> DataFrame:
    """Gaps and islands: maximal runs of indexes ``i`` in which no step is over ``max_gap`` + 1 (first, last, rows)."""
    order = Window.partitionBy(*by).orderBy(i)
    new = F.when(F.col(i) - F.lag(i).over(order) > max_gap + 1, 1).otherwise(0)
    marked = df.select(*by, i).withColumn("_new", new)
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min(i).alias("first"), F.max(i).alias("last"), F.count("*").alias("n")).drop("_run")


def longest_run(df: DataFrame, by: list[str], i: str, max_gap: int = 0) -> DataFrame:
    """The longest run of each group, the first of several."""
    r = runs(df, by, i, max_gap)
    at = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("last") - F.col("first")).desc(), "first"))
    return r.withColumn("_at", at).where("_at = 1").drop("_at")


def merge_neighbours(df: DataFrame, by: list[str], i: str, label: str) -> DataFrame:
    """Consecutive rows with equal labels as one: first, last, rows."""
    order = Window.partitionBy(*by).orderBy(i)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(order)) & F.lag(i).over(order).isNotNull(), 0).otherwise(1)
    marked = df.select(*by, i, label).withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run", label).agg(F.min(i).alias("first"), F.max(i).alias("last"), F.count("*").alias("n")).drop("_run")


def novelty(df: DataFrame, by: list[str], i: str, features: list[str], energy: str, width: int) -> DataFrame:
    """``df`` with ``novelty``: how the ``width`` rows before differ from the ``width`` rows from each on; 0 at the first.

    The distance of the mean features over the root of their number, and twice that of the mean energy.
    """
    order = Window.partitionBy(*by).orderBy(i)
    before, after = order.rowsBetween(-width, -1), order.rowsBetween(0, width - 1)
    apart = lambda c: F.avg(c).over(before) - F.avg(c).over(after)
    squares = reduce(lambda x, y: x + y, [apart(c) * apart(c) for c in features])
    return df.withColumn("novelty", F.coalesce(F.sqrt(squares) / F.sqrt(F.lit(float(len(features)))) + F.lit(2.0) * F.abs(apart(energy)), F.lit(0.0)))


def boundaries(df: DataFrame, by: list[str], i: str, value: str, min_bars: int, threshold: float) -> DataFrame:
    """``by``, ``i`` and ``value`` of the rows where a section starts: the first, and peaks at least ``min_bars`` from either end and from stronger ones.

    Peaks are no less than both neighbours and at least ``threshold`` of the
    greatest peak that far from the ends. Index ``i`` counts from 0.
    """
    part = Window.partitionBy(*by)
    order, v = part.orderBy(i), F.col(value)
    marked = df.withColumns({"_n": F.count("*").over(part), "_low": F.lag(value).over(order), "_high": F.lead(value).over(order)})
    peaks = marked.where(F.col(i).between(max(1, min_bars), F.col("_n") - min_bars) & (v >= F.coalesce("_low", v)) & (v >= F.coalesce("_high", v)))
    peaks = peaks.withColumn("_most", F.max(value).over(part)).where((F.col("_most") > 0) & (v >= F.col("_most") * threshold))
    found = peaks if min_bars <= 1 else suppress(peaks, by, i, value, min_bars, 2**31 - 1)
    return df.where(F.col(i) == 0).select(*by, i, value).unionByName(found.select(*by, i, value))


def label_sections(df: DataFrame, by: list[str], i: str, energy: str, chorus: float = 0.7, relative: float = 0.85, calm: float = 0.35) -> DataFrame:
    """``df`` with ``label``: chorus by energy; first and last others intro and outro if calm or among more than two; a calm verse between choruses bridge."""
    part = Window.partitionBy(*by)
    order = part.orderBy(i)
    e = F.col(energy)
    marked = df.withColumns({"_n": F.count("*").over(part), "_at": F.row_number().over(order), "_c": e >= F.greatest(F.lit(chorus), F.max(energy).over(part) * relative)})
    marked = marked.withColumns(
        {
            "_before": F.coalesce(F.max(F.col("_c").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_after": F.coalesce(F.max(F.col("_c").cast("int")).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
        }
    )
    edge = (e < calm) | (F.col("_n") > 2)
    label = (
        F.when(F.col("_c"), "chorus").when((F.col("_at") == 1) & edge, "intro").when((F.col("_at") == F.col("_n")) & edge, "outro")
        .when((F.col("_before") == 1) & (F.col("_after") == 1) & (e < calm), "bridge").otherwise("verse")
    )
    return marked.withColumn("label", label).drop("_n", "_at", "_c", "_before", "_after")


def jumps(df: DataFrame, by: list[str], i: str, value: str, width: int, min_jump: float, min_level: float) -> DataFrame:
    """Candidate drops: rows where the mean of the next ``width`` rows exceeds that of the ``width`` before by ``min_jump`` and reaches ``min_level``; all of the ``width`` before have to be there."""
    order = Window.partitionBy(*by).orderBy(i)
    marked = df.withColumns({"_b": F.when(F.count("*").over(order.rowsBetween(-width, -1)) == width, F.avg(value).over(order.rowsBetween(-width, -1))), "level": F.avg(value).over(order.rowsBetween(0, width - 1))})
    return marked.withColumn("jump", F.col("level") - F.col("_b")).where((F.col("jump") >= min_jump) & (F.col("level") >= min_level)).drop("_b")


def suppress(df: DataFrame, by: list[str], i: str, strength: str, distance: int, most: int) -> DataFrame:
    """Greedy suppression: strongest first (ties: earlier), each removes those nearer than ``distance``; at most ``most`` a group, the strongest."""
    rows = df.select(*by, F.col(i).cast("long").alias(i), F.col(strength).cast("double").alias(strength))
    gone = boxes.beaten(boxes.nearby(rows, by, i, F.col(strength), distance), by).withColumnRenamed("id", i)
    kept = rows.join(gone, [*by, i], "left_anti")
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(strength).desc(), i))
    return kept.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def zscore(value: str, by: list[str]) -> Column:
    """Population z-score; 0 where the deviation vanishes."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 1e-9, (F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(0.0))


def bpm(df: DataFrame, by: list[str], i: str, t: str) -> DataFrame:
    """60 over the least-squares slope of times by index; 0 below two beats or without a positive slope."""
    g = df.groupBy(*by).agg(F.count("*").alias("_n"), F.regr_slope(t, i).alias("_s"))
    return g.select(*by, F.when((F.col("_n") >= 2) & (F.col("_s") > 0), F.lit(60.0) / F.nullif("_s", F.lit(0.0))).otherwise(F.lit(0.0)).alias("bpm"))


def downbeat_phase(df: DataFrame, by: list[str], i: str, value: str | list[str], beats: int = 4) -> DataFrame:
    """The phase of ``beats`` with the greatest mean, the first of several. Several signals count by the sum of their z-scores in the group."""
    if not isinstance(value, str):
        df = df.withColumn("_sum", reduce(lambda a, b: a + b, [zscore(v, by) for v in value]))
        value = "_sum"
    means = df.groupBy(*by, (F.col(i) % beats).cast("int").alias("phase")).agg(F.round(F.avg(value), 6).alias("mean"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("mean").desc(), "phase"))
    return means.withColumn("_at", at).where("_at = 1").drop("_at")


def musical_key(histogram: DataFrame, key: str, pc: str, value: str, major: tuple[float, ...], minor: tuple[float, ...]) -> DataFrame:
    """``tonic``, ``major``, ``strength`` and ``majorness`` of each ``key`` from its twelve semitones (``pc`` from 0, absent ones not counted).

    The best of 24 rotated profiles by correlation, the lowest tonic of several
    and major before minor. A lead of 0.1 of either mode is a clear one. A flat
    histogram is tonic 0 in major, with strength 0 and majorness 0.5.
    """
    weight = lambda profile, tonic: F.element_at(F.array(*map(F.lit, profile)), ((F.col(pc) - tonic + 12) % 12 + 1).cast("int"))
    tonics = F.array(*[F.struct(F.lit(t).cast("long").alias("tonic"), weight(major, t).alias("up"), weight(minor, t).alias("down")) for t in range(12)])
    fit = lambda w: F.round(F.coalesce(F.covar_pop(value, w) / F.nullif(F.stddev_pop(value) * F.stddev_pop(w), F.lit(0.0)), F.lit(0.0)), 6)
    fits = histogram.select(key, value, F.inline(tonics)).groupBy(key, "tonic").agg(fit("up").alias("up"), fit("down").alias("down"), F.stddev_pop(value).alias("dev"))
    best = lambda c: F.max(F.struct(F.col(c).alias("r"), (-F.col("tonic")).alias("t")))
    both = fits.groupBy(key).agg(best("up").alias("x"), best("down").alias("y"), F.max("dev").alias("dev"))
    flat, up = F.coalesce(F.col("dev"), F.lit(0.0)) < 1e-9, F.col("x.r") >= F.col("y.r")
    majorness = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.lit(5.0) * (F.col("x.r") - F.col("y.r")))), 5)
    pick = lambda a, b, none: F.when(flat, none).when(up, a).otherwise(b)
    return both.select(
        key, pick(-F.col("x.t"), -F.col("y.t"), F.lit(0).cast("long")).alias("tonic"), (flat | up).alias("major"),
        pick(F.col("x.r"), F.col("y.r"), F.lit(0.0)).alias("strength"), F.when(flat, F.lit(0.5)).otherwise(majorness).alias("majorness"),
    )


def robust_unit(df: DataFrame, by: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``df`` with ``unit``: the value scaled from the low to the high percentile (interpolated) and clipped to 0 and 1."""
    ends = df.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_lo")) / F.nullif(span, F.lit(0.0))))).otherwise(F.lit(0.0))
    return df.join(ends, by).withColumn("unit", unit).drop("_lo", "_hi")


def smooth(df: DataFrame, by: list[str], i: str, value: str, width: int) -> DataFrame:
    """``df`` with ``smooth``: moving average in which the first and last value stand for those beyond the ends."""
    part = Window.partitionBy(*by)
    order = part.orderBy(i)
    left, right = width // 2, width - 1 - width // 2
    n, at = F.count("*").over(part), F.row_number().over(order)
    inside = F.sum(value).over(order.rowsBetween(-left, right))
    first, last = F.first(value).over(part.orderBy(i).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(part.orderBy(i).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("smooth", (inside + F.greatest(F.lit(0), left - (at - 1)) * first + F.greatest(F.lit(0), right - (n - at)) * last) / width)
