"""Transitions and effects of an edit by rules: what holds where, which of several holds first, and how long it may last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.music import edit_offset
from tessella.operators.intervals import near_any
from tessella.operators.planner import frame_counts

#: Shortest flash in frames; a slot's end that a freeze leaves running, in seconds.
FLASH_FRAMES, FREEZE_LEAST = 2, 0.3


@dataclass(frozen=True)
class Rule:
    """An effect for some zones (none named: all) and slots of a length in seconds; ``values`` are its settings."""

    zones: tuple[str, ...] = ()
    least: float = 0.0
    values: tuple[float, ...] = ()
    at: str = "cut"

    def applies(self) -> Column:
        zone = F.coalesce(F.col("section").isin(*self.zones), F.lit(False)) if self.zones else F.lit(True)
        return zone & (F.col("end") - F.col("start") >= self.least - 1e-9)


@dataclass(frozen=True)
class Transitions:
    """The kind of transition at a cut: into a drop, into another section, on a downbeat, else ``default``; the first that is set holds. ``beats``: how long a blend lasts."""

    default: str = "cut"
    downbeat: str | None = None
    section: str | None = None
    drop: str | None = None
    beats: float = 1.0

    def pick(self, drop: Column, section: Column, downbeat: Column) -> Column:
        kind = F.lit(self.default)
        for name, test in ((self.downbeat, downbeat), (self.section, section), (self.drop, drop)):  # the last one set goes first
            kind = F.when(test, name).otherwise(kind) if name else kind
        return kind


def prepare(slots: DataFrame, ramp: Rule | None = None, slowmo: Rule | None = None, freeze: Rule | None = None) -> DataFrame:
    """``slots`` with ``pieces`` (until, speed) of their source: a ramp (slow, fast, share of the slot that is slow) before slow motion (speed), else none.

    Where a freeze applies, hits from 0.3 of the slot on come first, those nearest to 0.6 of it before others.
    """
    size = F.col("end") - F.col("start")
    piece = lambda until, speed: F.struct((size * F.lit(until)).alias("until"), F.lit(speed).alias("speed"))
    pieces = F.array().cast("array<struct<until:double,speed:double>>")
    if slowmo:
        pieces = F.when(slowmo.applies(), F.array(piece(1.0, slowmo.values[0]))).otherwise(pieces)
    if ramp:
        slow, fast, split = ramp.values
        pieces = F.when(ramp.applies(), F.array(piece(split, slow), piece(1.0, fast))).otherwise(pieces)
    out = slots.withColumn("pieces", pieces)
    if freeze:
        late = lambda h: h >= F.lit(0.3) * size
        near = F.array_sort(F.transform(F.filter("hits", late), lambda h: F.struct(F.abs(h - F.lit(0.6) * size).alias("d"), F.array_position("hits", h).alias("i"), h.alias("h"))))
        moved = F.concat(F.transform(near, lambda x: x["h"]), F.filter("hits", lambda h: ~late(h)))
        out = out.withColumn("hits", F.when(freeze.applies() & (F.size("hits") > 1), moved).otherwise(F.col("hits")))
    return out


def transitions(slots: DataFrame, downbeats: DataFrame, axis: str, rules: Transitions, beat: float, fps: int, share: float = 0.5, flash: float = 0.15, whip: float = 0.2) -> DataFrame:
    """``slots`` with ``frames``, and ``kind`` and ``length`` of the transition into each and of the one out of it (``out_kind``, ``out_length``).

    A transition takes at most ``share`` of the shorter of its two slots, a
    flash of the slot it begins. Blends have their frames on each side of the
    cut. What would be too short to see is a plain cut, as is the first.
    """
    order = Window.partitionBy(axis).orderBy("slot_no")
    s = frame_counts(slots, [axis], fps).withColumns({"_zone": F.lag("section").over(order), "_before": F.lag("frames").over(order)})
    on = near_any(s.select(axis, "slot_no", F.col("start").alias("t")), downbeats.select(axis, F.col("d").alias("m")), axis, 0.25 * beat).select(axis, "slot_no", F.lit(True).alias("_down"))
    s = s.join(on, [axis, "slot_no"], "left")
    another = ~F.col("section").eqNullSafe(F.col("_zone"))
    kind = rules.pick((F.col("section") == "drop") & another, another, F.coalesce("_down", F.lit(False)))
    limit = F.lit(share) * F.least("_before", "frames")
    total = F.when(F.col("_kind") == "whip", F.lit(whip * fps)).otherwise(F.lit(rules.beats * beat * fps))
    side = F.floor(F.floor(F.least(total, limit)) / 2).cast("int")
    short = F.least(F.bround(F.lit(flash * fps)), F.floor(F.lit(share) * F.col("frames"))).cast("int")
    length = F.when(F.col("_before").isNull() | (F.col("_kind") == "cut"), 0).when(F.col("_kind") == "flash", F.when(short >= FLASH_FRAMES, short).otherwise(0)).otherwise(F.greatest(F.lit(0), side))
    s = s.withColumn("_kind", kind).withColumn("length", length).withColumn("kind", F.when(F.col("length") > 0, F.col("_kind")).otherwise("cut"))
    after = lambda c, none: F.coalesce(F.lead(c).over(order), F.lit(none))
    return s.withColumns({"out_kind": after("kind", "cut"), "out_length": after("length", 0)}).drop("_zone", "_before", "_down", "_kind")


def effects(slots: DataFrame, downbeats: DataFrame, axis: str, beat: float, punch: Rule | None = None, shake: Rule | None = None, push: Rule | None = None, freeze: Rule | None = None) -> DataFrame:
    """``slots`` (of ``prepare``, with ``aligned`` and ``peak``, the source seconds from its beginning to its peak) with ``punches``, ``shake``, ``push_in``, ``freeze_at`` and ``labels``.

    Punches are at the cut, at all hits, or at the downbeats inside (from a
    quarter of a beat before the slot on). A slot freezes on the peak of an
    aligned clip, where that lies neither early nor near the end.
    """
    size, none = F.col("end") - F.col("start"), F.array().cast("array<double>")
    out = slots.withColumns({"punches": none, "shake": F.lit(0.0), "push_in": F.lit(0.0), "freeze_at": F.lit(None).cast("double")})
    if punch and punch.at == "downbeats":
        tol = 0.25 * beat
        # A downbeat lies in one slot, so it meets the slot by the stretches of the axis both touch.
        width = F.lit(4 * beat)
        cell = lambda c: F.floor(c / width)
        own = slots.where(punch.applies()).select(axis, "slot_no", "start", "end", F.explode(F.sequence(cell(F.col("start") - tol), cell(F.col("end") - tol))).alias("_c"))
        met = own.join(downbeats.select(axis, "d", cell(F.col("d")).alias("_c")), [axis, "_c"]).where((F.col("d") >= F.col("start") - tol) & (F.col("d") < F.col("end") - tol))
        times = met.groupBy(axis, "slot_no").agg(F.sort_array(F.collect_list(F.greatest(F.lit(0.0), F.round(F.col("d") - F.col("start"), 4)))).alias("_times"))
        out = out.join(times, [axis, "slot_no"], "left").withColumn("punches", F.coalesce("_times", none)).drop("_times")
    elif punch:
        times = F.array(F.lit(0.0)) if punch.at == "cut" else F.transform(F.sort_array("hits"), lambda h: F.greatest(F.lit(0.0), F.round(h, 4)))
        out = out.withColumn("punches", F.when(punch.applies(), times).otherwise(none))
    for name, rule in (("shake", shake), ("push_in", push)):
        if rule:
            out = out.withColumn(name, F.when(rule.applies(), F.lit(rule.values[0])).otherwise(0.0))
    if freeze:
        at = F.when(F.size("pieces") > 0, edit_offset(F.col("peak"), F.col("pieces"))).otherwise(F.col("peak"))
        fits = freeze.applies() & F.col("aligned") & at.between(F.lit(0.25) * size, size - FREEZE_LEAST)
        out = out.withColumn("freeze_at", F.when(fits, F.round(at, 4)))
    speed = F.array_join(F.transform("pieces", lambda p: F.concat(F.regexp_replace(p["speed"].cast("string"), r"\.0$", ""), F.lit("x"))), ">")
    names = F.array(
        F.when(F.size("pieces") > 0, F.concat(F.lit("tempo "), speed)), F.when(F.size("punches") > 0, F.concat(F.lit("zoom_punch x"), F.size("punches").cast("string"))),
        F.when(F.col("shake") > 0, "shake"), F.when(F.col("push_in") > 0, "push_in"), F.when(F.col("freeze_at").isNotNull(), "freeze"),
    )
    return out.withColumn("labels", F.array_compact(names))
