"""Songs and the slots of an edit: mean energy by prefix sums, zones of cutting, and the walk over the beats.

Times are whole ticks (long) from the beginning of the song, so that sums and
comparisons are exact. Every song is a value of ``axis``; nothing is joined by
the axis alone, and no step runs over a song row after row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.intervals import section_at
from tessella.session import written


@dataclass(frozen=True)
class CutRules:
    """Beats between two cuts by label of the section, in a drop and, from first to last bar, before one; bars of both; ``shortest`` ticks of a cut."""

    beats_per_cut: dict[str, float] = field(default_factory=lambda: {"intro": 4.0, "verse": 2.0, "chorus": 1.0, "bridge": 2.0, "outro": 4.0})
    other: float = 2.0
    drop: float = 0.5
    drop_bars: int = 4
    buildup_bars: int = 4
    buildup_from: float = 4.0
    buildup_to: float = 1.0
    beats_per_bar: int = 4
    shortest: int = 0


# Mean energy ---------------------------------------------------------------------------------------------------------------
def prefix_sums(curve: DataFrame, axis: str, i: str = "i", value: str = "value") -> DataFrame:
    """An index of a curve, dense from 0: ``before``, the sum of the values below each ``i`` from 0 to their number ``n``."""
    part = Window.partitionBy(axis)
    upto = F.sum(value).over(part.orderBy(i).rowsBetween(Window.unboundedPreceding, 0))
    inside = curve.select(axis, F.col(i).cast("long").alias("i"), (upto - F.col(value)).alias("before"), F.count("*").over(part).alias("n"))
    ends = curve.groupBy(axis).agg(F.sum(value).alias("before"), F.count("*").alias("n")).select(axis, F.col("n").alias("i"), "before", "n")
    return inside.unionByName(ends)


def mean_between(rows: DataFrame, sums: DataFrame, axis: str, start: str, end: str, step: int, name: str = "mean") -> DataFrame:
    """``rows`` with the mean of the values of a curve from the one that holds ``start`` to the one before ``end``; one value at least, 0 without a curve.

    A value stands for ``step`` ticks. Two look-ups in the prefix sums, whatever the length of the interval.
    """
    n = F.col("_n")
    sizes = sums.where("i = n").select(axis, F.col("n").alias("_n"))
    a = F.greatest(F.lit(0), F.least(F.floor(F.col(start) / step), n - 1))
    b = F.greatest(F.col("_a") + 1, F.least(F.ceil(F.col(end) / step), n))
    look = lambda k: sums.select(axis, F.col("i").alias(k), F.col("before").alias(f"{k}_sum"))
    asked = rows.join(sizes, axis, "left").withColumn("_a", a).withColumn("_b", b)
    met = asked.join(look("_a"), [axis, "_a"], "left").join(look("_b"), [axis, "_b"], "left")
    mean = F.coalesce((F.col("_b_sum") - F.col("_a_sum")) / (F.col("_b") - F.col("_a")), F.lit(0.0))
    return met.withColumn(name, mean).select(*rows.columns, name)


def sections_with_energy(sections: DataFrame, songs: DataFrame, sums: DataFrame, axis: str, step: int) -> DataFrame:
    """``sections`` (``start, end, label``) cut to their song (``duration``), empty ones dropped, with their mean ``energy``."""
    cut = sections.join(songs.select(axis, "duration"), axis).withColumns({"start": F.greatest(F.col("start"), F.lit(0)), "end": F.least("end", "duration")})
    return mean_between(cut.where("end > start").drop("duration"), sums, axis, "start", "end", step, "energy")


# Zones -----------------------------------------------------------------------------------------------------------------------
def _section_of(points: DataFrame, sections: DataFrame, axis: str) -> DataFrame:
    """``points`` (``t``) with ``section`` (``end``, ``label``): the one that holds the point, behind all of them the last, else null."""
    last = F.lead("start").over(Window.partitionBy(axis).orderBy("start")).isNull()
    s = sections.select(axis, F.col("start").alias("ss"), F.struct("end", "label", last.alias("last")).alias("label"))
    met = section_at(points, s, axis)
    return met.withColumn("section", F.when((F.col("t") < F.col("label.end")) | F.col("label.last"), F.struct("label.end", "label.label"))).drop("ss", "label")


def drop_windows(drops: DataFrame, sections: DataFrame, songs: DataFrame, axis: str, rules: CutRules) -> DataFrame:
    """Disjoint windows (``start, end, kind``) of drops and of the build-ups before them.

    A drop lasts some bars, or to the end of its section; a build-up begins some
    bars before, or where the drop before ended. Where windows overlap the
    earlier drop has the time, so each keeps what lies behind the end of all before it.
    """
    timed = drops.join(songs.select(axis, "beat"), axis).withColumns({"tol": F.expr("beat div 4"), "bar": F.col("beat") * rules.beats_per_bar})
    met = _section_of(timed.withColumn("t", F.col("time") + F.col("tol")), sections, axis)
    end = F.col("time") + F.col("bar") * rules.drop_bars
    met = met.withColumn("drop_end", F.when(F.col("section.end") > F.col("t"), F.least(end, F.col("section.end"))).otherwise(end))
    before = F.coalesce(F.lag("drop_end").over(Window.partitionBy(axis).orderBy("time")), F.lit(0))
    met = met.withColumn("build", F.greatest(before, F.col("time") - F.col("bar") * rules.buildup_bars))
    parts = F.array(
        F.struct(F.col("build").alias("start"), F.col("time").alias("end"), F.lit("buildup").alias("kind"), (F.lit(rules.buildup_bars > 0) & (F.col("time") - F.col("build") > F.col("tol"))).alias("is")),
        F.struct(F.col("time").alias("start"), F.col("drop_end").alias("end"), F.lit("drop").alias("kind"), F.lit(True).alias("is")),
    )
    w = met.select(axis, "time", F.inline(parts)).where("is")
    reach = F.max("end").over(Window.partitionBy(axis).orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, -1))
    return w.withColumn("start", F.greatest("start", F.coalesce(reach, F.col("start")))).where("start < end").select(axis, "start", "end", "kind")


def zones_per_beat(beats: DataFrame, songs: DataFrame, sections: DataFrame, drops: DataFrame, axis: str, rules: CutRules) -> DataFrame:
    """``beats`` (``i, t``) with ``label`` and ``rate``, the beats between two cuts there.

    A beat belongs to what begins up to a quarter of a beat after it: a drop or
    build-up first, else its section, else verse. The bars of a build-up are
    counted back from the drop, so the last one has the last rate.
    """
    steps = [rules.buildup_to] if rules.buildup_bars == 1 else [rules.buildup_from * (rules.buildup_to / rules.buildup_from) ** (k / (rules.buildup_bars - 1)) for k in range(rules.buildup_bars)]
    rates = F.array(*[F.pow(F.lit(2.0), F.bround(F.log2(F.lit(float(s))))) if len(steps) > 1 else F.lit(float(s)) for s in steps] or [F.lit(0.0)])
    at = beats.join(songs.select(axis, "beat"), axis).select(axis, "i", F.col("t").alias("own"), (F.col("t") + F.expr("beat div 4")).alias("t"), (F.col("beat") * rules.beats_per_bar).alias("bar"))
    windows = drop_windows(drops, sections, songs, axis, rules).select(axis, F.col("start").alias("ss"), F.struct("end", "kind").alias("label"))
    met = _section_of(section_at(at, windows, axis).withColumn("w", F.when(F.col("t") < F.col("label.end"), F.col("label"))).drop("ss", "label"), sections, axis)
    left = F.floor((F.col("w.end") - F.col("t")) / F.col("bar")).cast("int")
    by_label = F.lit(rules.other)
    for name, rate in rules.beats_per_cut.items():
        by_label = F.when(F.coalesce("section.label", F.lit("verse")) == name, F.lit(float(rate))).otherwise(by_label)
    rate = F.when(F.col("w.kind") == "drop", F.lit(float(rules.drop))).when(F.col("w.kind") == "buildup", F.get(rates, F.greatest(F.lit(0), F.lit(rules.buildup_bars - 1) - left))).otherwise(by_label)
    return met.select(axis, "i", F.col("own").alias("t"), F.coalesce("w.kind", "section.label", F.lit("verse")).alias("label"), rate.alias("rate"))


# Where an edit starts and is cut -------------------------------------------------------------------------------------------
def edit_starts(songs: DataFrame, beats: DataFrame, downbeats: DataFrame, sections: DataFrame, drops: DataFrame, axis: str, length: int, drop_at: float = 0.4) -> DataFrame:
    """Where each song begins in an edit of ``length``: the downbeat nearest to what puts the strongest drop, else the first chorus, at ``drop_at`` of it.

    Songs shorter than the edit are left out. The edit has to fit behind the
    start; the earlier of two is taken, and 0 where none fits. Songs without
    downbeats take beats.
    """
    s = songs.where(F.col("duration") >= length)
    main = drops.groupBy(axis).agg(F.max_by("time", F.struct(F.col("strength"), -F.col("time"))).alias("main"))
    chorus = sections.where("label = 'chorus'").groupBy(axis).agg(F.min("start").alias("chorus"))
    marks = beats.select(axis, "t", F.lit(1).alias("kind")).unionByName(downbeats.select(axis, F.col("d").alias("t"), F.lit(0).alias("kind")))
    least = F.min("kind").over(Window.partitionBy(axis))
    grid = marks.withColumn("least", least).where("kind = least")
    first = grid.groupBy(axis).agg(F.min("t").alias("first"))
    aim = s.join(main, axis, "left").join(chorus, axis, "left").join(first, axis, "left")
    shift = F.round(F.lit(drop_at) * length).cast("long")
    aim = aim.withColumn("target", F.coalesce(F.col("main") - shift, F.col("chorus") - shift, F.col("first"), F.lit(0)))
    fits = grid.join(aim.select(axis, "target", "duration"), axis).where((F.col("t") >= 0) & (F.col("t") <= F.col("duration") - length))
    best = fits.groupBy(axis).agg(F.min_by("t", F.struct(F.abs(F.col("t") - F.col("target")), F.col("t"))).alias("song_start"))
    return s.select(axis).join(best, axis, "left").withColumn("song_start", F.coalesce("song_start", F.lit(0).cast("long")))


def walk(steps: DataFrame, starts: DataFrame, axis: str) -> DataFrame:
    """The nodes (``axis, node``) that following ``steps`` (``node, next``) meets from ``starts``, themselves included.

    ``next`` is above ``node``, and each node has one. By doubling: what is met
    within 2^k steps, and where 2^k steps lead, give both for 2^(k+1). So a path
    of n steps takes log2(n) rounds, each a join by node that runs wide.
    """
    met, jumps = written(starts.select(axis, "node"), "met"), steps.select(axis, "node", "next")
    while True:
        jumps = written(jumps, "jumps")
        more = written(met.join(jumps, [axis, "node"]).select(axis, F.col("next").alias("node")), "more")
        if more.isEmpty():
            return met
        met = met.unionByName(more)
        further = jumps.select(axis, F.col("node").alias("next"), F.col("next").alias("further"))
        jumps = jumps.join(further, [axis, "next"]).select(axis, "node", F.col("further").alias("next"))


def walks(steps: DataFrame, axis: str, start: Column) -> DataFrame:
    """``walk`` where the steps of a song fit a task: the rows of ``steps`` (``node, next`` and more) that are met from ``start``, an aggregate of them.

    One pass over the nodes of each song in their order, so the rows travel once; ``walk`` is for longer ones.
    """
    fields = ["node", *[c for c in steps.columns if c not in (axis, "node")]]
    songs = steps.groupBy(axis).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all"), start.cast("long").alias("_first"))
    begin = F.struct(F.col("_first").alias("at"), F.slice("_all", 1, 0).alias("met"))
    step = lambda acc, x: F.when(x["node"] == acc["at"], F.struct(x["next"].cast("long").alias("at"), F.concat(acc["met"], F.array(x)).alias("met"))).otherwise(acc)
    return songs.select(axis, F.inline(F.aggregate("_all", begin, step)["met"])).select(*steps.columns)


def song_slots(
    zones: DataFrame, songs: DataFrame, downbeats: DataFrame, sums: DataFrame, starts: DataFrame, axis: str, length: int, rules: CutRules, step: int, min_slot: int = 0, parts: int = 8
) -> DataFrame:
    """The slots of an edit of each song from its ``song_start`` on: ``slot_no, start, end, section, intensity, hits``.

    A cut follows after as many beats as the zone of its beat says, and at
    every change of zone; half beats and smaller ones lie between beats, and a
    rate below a beat is doubled until it is no shorter than ``rules.shortest``.
    Rates are multiples of 1/``parts`` of a beat; only the parts that all of a
    song's strides can meet are nodes. The last slot ends with the edit; one shorter than ``min_slot`` is not begun. ``hits`` are the cut
    itself, then the beats inside on downbeats, then the other ones.
    """
    order = Window.partitionBy(axis).orderBy("i")
    whole = Window.partitionBy(axis)
    turn = ~(F.col("label").eqNullSafe(F.lag("label").over(order)) & F.col("rate").eqNullSafe(F.lag("rate").over(order)))
    z = zones.withColumns({"turn": F.when(turn, F.col("i")), "n": F.count("*").over(whole), "gap": F.lead("t").over(order) - F.col("t")})
    z = z.withColumn("change", F.coalesce(F.min("turn").over(order.rowsBetween(1, Window.unboundedFollowing)), F.col("n")))
    z = z.join(starts, axis).withColumn("song_end", F.col("song_start") + length)
    nearest = z.groupBy(axis).agg(F.min_by("i", F.struct(F.abs(F.col("t") - F.col("song_start")), "i")).alias("first"))
    slower = F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.col("rate") * F.pow(F.lit(2.0), k)), lambda r: (r >= 1) | (F.col("gap") * r >= rules.shortest))[0]
    stride = F.round(F.when(F.col("gap").isNull(), F.col("rate")).otherwise(F.coalesce(slower, F.col("rate"))) * parts).cast("long")
    z = written(z.join(nearest, axis).where("i >= first").withColumn("stride", F.greatest(F.lit(1), stride)), "zones")
    node = F.col("i") * parts + F.col("r")
    place = F.col("t") + F.expr(f"coalesce(gap * r, 0) div {parts}")
    # The greatest power of two in all strides of a song and in ``parts``: all nodes that can be met are multiples of it.
    power = lambda x: x.bitwiseAND(-x)
    grain = F.min(F.least(power(F.col("stride")), F.lit(parts & -parts))).over(whole)
    nodes = z.withColumn("grain", grain).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("r")).where("r % grain = 0 and (r = 0 or gap is not null)")
    nodes = nodes.select(axis, node.alias("node"), place.alias("at"), F.least(node + F.col("stride"), F.col("change") * parts).alias("next"), "label", "first", "song_start", "song_end")
    nodes = nodes.where((F.col("node") == F.col("first") * parts) | (F.col("at") < F.col("song_end") - min_slot))
    cuts = walks(nodes, axis, F.min("first") * parts)
    at = Window.partitionBy(axis).orderBy("node")
    cuts = cuts.withColumn("slot_no", F.row_number().over(at).cast("long") - 1).withColumn("t0", F.when(F.col("slot_no") == 0, F.col("song_start")).otherwise(F.col("at")))
    cuts = written(cuts.withColumn("t1", F.coalesce(F.lead("t0").over(at), F.col("song_end"))), "cuts")
    slots = mean_between(cuts, sums, axis, "t0", "t1", step, "intensity")
    points = z.select(axis, F.col("t").alias("own"), (F.col("i") * parts).alias("t"))
    inner = section_at(points, cuts.select(axis, F.col("node").alias("ss"), F.struct("slot_no", "t0", "t1").alias("label")), axis)
    inner = inner.where("own > label.t0 and own < label.t1").select(axis, F.col("own").alias("t"), F.col("label.slot_no").alias("slot_no"), (F.col("own") - F.col("label.t0")).alias("hit"))
    down = _near(inner.select(axis, "t"), downbeats, songs, axis)
    hits = inner.join(down.withColumn("down", F.lit(True)), [axis, "t"], "left").groupBy(axis, "slot_no").agg(F.array_sort(F.collect_list(F.struct(F.col("down").isNull().alias("off"), "hit"))).alias("hits"))
    own = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(F.transform("hits", lambda h: h["hit"]), F.array().cast("array<bigint>")))
    return slots.join(hits, [axis, "slot_no"], "left").select(
        axis, "slot_no", (F.col("t0") - F.col("song_start")).alias("start"), (F.col("t1") - F.col("song_start")).alias("end"), F.col("label").alias("section"), "intensity", own.alias("hits")
    )


def _near(points: DataFrame, downbeats: DataFrame, songs: DataFrame, axis: str) -> DataFrame:
    """The points ``t`` nearer to a downbeat than a quarter of their song's beat."""
    scaled = lambda df: df.join(songs.select(axis, F.expr("greatest(1, beat div 4)").alias("tol")), axis)
    # Buckets as wide as the song's own quarter beat make the band join an equi-join.
    p = scaled(points).withColumn("_b", F.explode(F.array(*[F.floor(F.col("t") / F.col("tol")) + k for k in (-1, 0, 1)])))
    d = scaled(downbeats.select(axis, "d")).select(axis, "d", F.floor(F.col("d") / F.col("tol")).alias("_b"))
    return p.join(d, [axis, "_b"]).where(F.abs(F.col("t") - F.col("d")) < F.col("tol")).select(axis, "t").distinct()


def slot_summary(slots: DataFrame, axis: str) -> DataFrame:
    """``section``, ``n``, ``mean`` length and ``first`` slot of the zones of each edit."""
    return slots.groupBy(axis, "section").agg(F.count("*").alias("n"), (F.sum(F.col("end") - F.col("start")) / F.count("*")).alias("mean"), F.min("slot_no").alias("first"))

