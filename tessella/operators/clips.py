"""What is measured and sampled inside clips: motion and its peak, key frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip_motion(clips: DataFrame, curve: DataFrame, axis: str, clip: str, step: int, edge: int = 0, smooth: int = 1) -> DataFrame:
    """``axis``, ``clip``, ``motion`` (the mean of the curve inside) and ``peak`` (the tick of its greatest smoothed value, the first of several).

    ``clips``: ``start, end`` in ticks; ``curve``: ``i, value``, dense from 0, one
    value each ``step`` ticks. ``edge`` ticks at either end, where the cut
    looks like motion, are left out unless fewer than two values remain. The
    moving sum of ``smooth`` values takes 0 beyond the ends; a clip of fewer
    values is not smoothed. Clips behind the end of the curve have no row.

    A clip is joined with its values by their index, so neither a long axis nor
    overlapping clips meet all values of an axis.
    """
    sizes = curve.groupBy(axis).agg(F.max("i").alias("_n"))
    first, last = F.greatest(F.lit(0), F.ceil(F.col("start") / step)), F.least(F.col("_n"), F.floor(F.col("end") / step))
    inner, outer = F.greatest(F.lit(0), F.ceil((F.col("start") + edge) / step)), F.least(F.col("_l"), F.floor((F.col("end") - edge) / step))
    cut = clips.join(sizes, axis).withColumns({"_f": first, "_l": last}).where("_f <= _l").withColumns({"_if": inner, "_il": outer})
    use = F.col("_il") - F.col("_if") >= 1
    span = F.sequence(F.when(use, F.col("_if")).otherwise(F.col("_f")), F.when(use, F.col("_il")).otherwise(F.col("_l")))
    values = cut.select(axis, clip, F.explode(span).alias("i")).join(curve.select(axis, "i", "value"), [axis, "i"])
    part = Window.partitionBy(axis, clip)
    around = F.sum("value").over(part.orderBy("i").rowsBetween(-(smooth // 2), (smooth - 1) // 2))
    height = F.when((F.lit(smooth) > 1) & (F.count("*").over(part) >= smooth), around).otherwise(F.col("value"))
    g = values.withColumn("_h", height).groupBy(axis, clip).agg(F.avg("value").alias("motion"), F.max_by("i", F.struct("_h", -F.col("i"))).alias("_p"))
    return g.select(axis, clip, F.round("motion", 4).alias("motion"), (F.col("_p") * step).alias("peak"))


def keyframe_times(start: Column, end: Column, fps: float, edge: float, seconds_per_frame: float, most: int) -> Column:
    """array<double>: seconds of the stills of a clip: evenly spread inside, away from its cuts, more for longer clips; the middle of a clip too short for that."""
    inner = (end - F.lit(edge)) - (start + F.lit(edge))
    count = F.least(F.lit(most), (F.floor((end - start) / F.lit(seconds_per_frame)) + 1).cast("int"))
    step = inner / count
    times = F.transform(F.sequence(F.lit(0), count - 1), lambda k: (start + F.lit(edge)) + (k + F.lit(0.5)) * step)
    return F.when(inner < 1.0 / fps, F.array((start + end) / 2)).otherwise(times)


def plan_frames(clips: DataFrame, axis: str, clip: str, fps: float, edge: float, seconds_per_frame: float, most: int) -> DataFrame:
    """``axis, clip, frame, thumbnail``: the frames to read for each clip (``start, end`` in seconds), none twice; the middle one is its thumbnail.

    Frames that several clips need are rows of each.
    """
    times = keyframe_times(F.col("start"), F.col("end"), fps, edge, seconds_per_frame, most)
    frames = F.array_distinct(F.transform(times, lambda t: F.bround(t * F.lit(float(fps))).cast("long")))
    planned = clips.select(axis, clip, frames.alias("f"))
    middle = F.get("f", F.floor(F.size("f") / 2).cast("int"))
    return planned.select(axis, clip, middle.alias("m"), F.explode("f").alias("frame")).select(axis, clip, "frame", (F.col("frame") == F.col("m")).alias("thumbnail"))


def frame_owners(plan: DataFrame, axis: str, clip: str) -> DataFrame:
    """For each frame to read once, the clips it is for, in order."""
    return plan.groupBy(axis, "frame").agg(F.array_sort(F.collect_list(F.struct(clip, "thumbnail"))).alias("owners"))


def usable(scenes: DataFrame, skip_start: Column, skip_end: Column) -> DataFrame:
    """``scenes`` cut to their video (``duration``) without its first and last seconds; what is empty then goes."""
    cut = scenes.withColumns({"start": F.greatest(F.col("start"), skip_start), "end": F.least(F.col("end"), F.col("duration") - skip_end)})
    return cut.where("end > start")


def clip_audio(clips: DataFrame, audio: DataFrame, axis: str, clip: str, rate: int, block: int, full: float = 1.0) -> DataFrame:
    """``axis, clip, loudness`` (dBFS, 2 digits): the root mean square of the samples of each clip against ``full`` scale.

    ``clips``: ``start, end`` in seconds, of samples from floor(start * rate) to
    before floor(end * rate); those beyond the audio do not count. ``audio``:
    ``block`` (from 0, without gaps) and ``samples``, ``block`` many of them but
    in the last. A clip without samples, or a silent one, has -100, one
    whose axis has no audio null.

    The squares of every block are summed once; a clip takes two look-ups of
    the sum before a sample, whatever its length, and samples meet only the
    ends of clips that lie in their block.
    """
    square = lambda a, x: a + x.cast("double") * x.cast("double")
    energy = lambda xs: F.aggregate(xs, F.lit(0.0), square)
    blocks = audio.select(axis, F.col("block").cast("long").alias("block"), F.size("samples").alias("_len"), energy(F.col("samples")).alias("_own"))
    before = Window.partitionBy(axis).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0.0)))
    whole = blocks.groupBy(axis).agg(F.sum("_len").alias("_n"), F.sum("_own").alias("_all"))
    sample = lambda c: F.least(F.greatest(F.floor(F.col(c) * rate), F.lit(0)), F.col("_n"))
    asked = clips.join(whole, axis, "left").select(axis, clip, "_n", "_all", sample("start").alias("_a"), sample("end").alias("_b"))
    ends = asked.where("_n is not null").select(axis, F.explode(F.array("_a", "_b")).alias("_at"), F.col("_n")).where("_at < _n").select(axis, "_at").distinct()
    ends = ends.withColumns({"block": F.expr(f"_at div {block}"), "_rest": (F.col("_at") % block).cast("int")})
    partial = ends.join(audio.select(axis, F.col("block").cast("long").alias("block"), "samples"), [axis, "block"]).select(axis, "block", "_at", energy(F.slice("samples", F.lit(1), F.col("_rest"))).alias("_part"))
    upto = partial.join(sums.select(axis, "block", "_before"), [axis, "block"]).select(axis, "_at", (F.col("_before") + F.col("_part")).alias("_upto"))
    look = lambda k: upto.select(axis, F.col("_at").alias(k), F.col("_upto").alias(f"{k}_sum"))
    met = asked.join(look("_a"), [axis, "_a"], "left").join(look("_b"), [axis, "_b"], "left")
    total = F.coalesce("_b_sum", "_all") - F.coalesce("_a_sum", "_all")
    rms = F.sqrt(F.greatest(total, F.lit(0.0)) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0))) / F.lit(full)
    decibel = F.round(F.greatest(F.lit(-100.0), 20 * F.log10(rms + 1e-10)), 2)
    return met.select(axis, clip, F.when(F.col("_n").isNotNull(), F.when(F.col("_b") > F.col("_a"), decibel).otherwise(F.lit(-100.0))).alias("loudness"))
