"""Upright windows for shots: where a window of fixed width lies so that the faces that count are inside, and how it moves with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPRIGHT = 9 / 16


@dataclass(frozen=True)
class FrameRules:
    margin: float = 0.02  # of the window, on either side of the faces
    least_share: float = 0.5  # of the greatest height, for a face to count
    too_wide: str = "pan"  # pan, main or fit
    pan_from: float = 1.2  # shorter shots do not pan
    around: float = 0.3  # faces so long before and after the shot still count
    slack: float = 0.005  # by so much a face may stick out


def window_width(aspect: Column) -> Column:
    """Width of the upright window as a share of the picture's; 1 for upright pictures and where the aspect is null or not above 0."""
    return F.when(aspect > 0, F.least(F.lit(1.0), F.lit(UPRIGHT) / aspect)).otherwise(F.lit(1.0))


def clamp(center: Column, width: Column) -> Column:
    """The middle of a window moved so that the window is inside the picture."""
    return F.least(F.greatest(center, width / 2), F.lit(1.0) - width / 2)


def frame_shots(shots: DataFrame, faces: DataFrame, key: list[str], rules: FrameRules = FrameRules(), to_slot: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """A framing for each shot: ``key``, ``mode, width, keys, focus_x, focus_y, faces, inside, main_inside, center_inside``.

    Shots have ``key, start, end, duration, aspect, motion_x`` (the middle of what
    moves, null for none), faces ``key, face_id, time, x0, y0, x1, y1,
    probability, wanted`` with boxes in shares of the picture. ``to_slot`` turns
    time since the start of the shot into time of the edit.

    Faces near the shot count, all where none is near; of these the wanted ones,
    else those of ``least_share`` of the greatest height. If they fit the window
    together, it holds them (``face``); if those of each moment do and there are
    several moments, it moves from one to the next (``face``, one key each). Else
    it stays on the main face (``main``), pans to the one farthest from it
    (``pan``) or takes the whole picture (``fit``). Shots without faces follow
    ``motion_x`` or stay in the middle (``center``), as do upright pictures. The
    main face is a wanted one before others, then the highest, the most
    probable, the one with the smallest id. Faces with a null in time or box do
    not count, nor do faces without a shot; null counts as not wanted and as
    probability 0.

    One exchange of shots and faces by ``key``; all steps are windows within it,
    which spill, so only the keys of one shot have to fit a value.
    """
    by = Window.partitionBy(*key)
    c, box = F.col, ["x0", "y0", "x1", "y1"]
    whole = faces.where(" and ".join(f"{x} is not null" for x in ["face_id", "time", *box]))
    own = whole.select(*key, "face_id", c("time").cast("double").alias("_t"), *[c(x).cast("double").alias(f"_{x}") for x in box], F.coalesce("probability", F.lit(0.0)).alias("_p"), F.coalesce("wanted", F.lit(False)).alias("_want"))
    s = shots.select(*key, "start", "end", "duration", "motion_x", window_width(c("aspect")).alias("width"))
    f = s.join(own, key, "left").withColumn("_face", c("face_id").isNotNull() & (c("width") < 1))
    f = f.withColumn("_near", c("_face") & (c("_t") >= c("start") - rules.around) & (c("_t") <= c("end") + rules.around))
    f = f.withColumn("_some", F.max("_near").over(by)).where("_near or not _some")
    f = f.withColumns({"_wants": F.max(c("_face") & c("_want")).over(by), "_h": c("_y1") - c("_y0")}).withColumn("_top", F.max("_h").over(by))
    f = f.where(~c("_face") | F.when(c("_wants"), c("_want")).otherwise(c("_h") >= c("_top") * rules.least_share))

    x, y = (c("_x0") + c("_x1")) / 2, (c("_y0") + c("_y1")) / 2
    at = F.least(F.greatest(to_slot(c("_t") - c("start")).cast("double"), F.lit(0.0)), c("duration").cast("double"))
    f = f.withColumns({"_x": x, "_y": y, "_at": at, "_inner": c("width") * (1 - 2 * rules.margin)})
    moment = Window.partitionBy(*key, "_at")
    f = f.withColumns({"_lo": F.min("_x0").over(moment), "_hi": F.max("_x1").over(moment)})
    # the first of each order: greatest values, then the smallest id
    main = F.max(F.struct("_want", "_h", "_p", (-c("face_id")).alias("id"), "_x", "_y", "_at", "_x0", "_x1", "_lo", "_hi")).over(by)
    f = f.withColumns({"_left": F.min("_x0").over(by), "_right": F.max("_x1").over(by), "_wide": F.max(c("_hi") - c("_lo")).over(by), "_several": F.min("_at").over(by) < F.max("_at").over(by), "_main": main})
    f = f.withColumn("_far", F.max(F.struct(F.abs(c("_x") - c("_main._x")).alias("d"), (-c("face_id")).alias("id"), c("_x").alias("x"))).over(by)["x"])

    together, follow = c("_right") - c("_left") <= c("_inner"), c("_several") & (c("_wide") <= c("_inner"))
    wide = {"fit": F.lit("fit"), "main": F.lit("main"), "pan": F.when(c("duration") >= rules.pan_from, "pan").otherwise("main")}[rules.too_wide]
    mode = F.when(~c("_face"), F.when((c("width") < 1) & c("motion_x").isNotNull(), "motion").otherwise("center")).when(together, "face").when(follow, "follow").otherwise(wide)
    w = c("width")
    middle = F.when(c("_mode") == "motion", clamp(c("motion_x"), w)).when(c("_mode") == "face", clamp((c("_left") + c("_right")) / 2, w)).when(c("_mode") == "follow", clamp((c("_lo") + c("_hi")) / 2, w)).when(c("_mode").isin("main", "pan"), clamp(c("_main._x"), w)).otherwise(F.lit(0.5))
    inside = lambda x0, x1, center: (x0 >= center - w / 2 - rules.slack) & (x1 <= center + w / 2 + rules.slack)
    other, main_at = clamp(c("_far"), w), F.when(c("_mode") == "follow", clamp((c("_main._lo") + c("_main._hi")) / 2, w)).otherwise(c("_c"))
    seen = lambda x0, x1, center: (c("_mode") == "fit") | inside(x0, x1, center) | ((c("_mode") == "pan") & inside(x0, x1, other))
    key_at = F.when(c("_mode") == "pan", c("duration") * 0.2).when(c("_mode") == "follow", c("_at")).otherwise(F.lit(0.0))
    focus = F.when(c("_mode").isin("face", "follow", "main"), (c("_main._x") - (main_at - w / 2)) / w).otherwise(F.lit(0.5))
    f = f.withColumn("_mode", mode).withColumn("_c", middle)
    f = f.select(
        *key, "_mode", "duration", w, c("_face"), key_at.alias("_key"), "_c", other.alias("_other"), focus.alias("focus_x"),
        F.when(c("_face") & (c("_mode") != "fit"), c("_main._y")).otherwise(F.lit(0.5)).alias("focus_y"), seen(c("_x0"), c("_x1"), c("_c")).alias("_in"),
        F.when(c("_face"), seen(c("_main._x0"), c("_main._x1"), main_at)).alias("_ok"), inside(c("_x0"), c("_x1"), F.lit(0.5)).alias("_mid"),
    )
    g = f.groupBy(*key).agg(
        F.first("_mode").alias("_mode"), F.first("duration").alias("duration"), F.first("width").alias("_width"), F.first("_other").alias("_other"), F.sort_array(F.collect_set(F.struct(c("_key").alias("at"), c("_c").alias("center")))).alias("_keys"),
        F.first("focus_x").alias("focus_x"), F.first("focus_y").alias("focus_y"), F.count_if("_face").alias("faces"), F.count_if(c("_face") & c("_in")).alias("inside"), F.first("_ok").alias("main_inside"), F.count_if(c("_face") & c("_mid")).alias("center_inside"),
    )
    pan = F.array_append("_keys", F.struct((c("duration") * 0.8).alias("at"), c("_other").alias("center")))
    return g.select(
        *key, F.when(c("_mode") == "follow", "face").otherwise(c("_mode")).alias("mode"), F.when(c("_mode") == "fit", 1.0).otherwise(c("_width")).alias("width"),
        F.when(c("_mode") == "pan", pan).otherwise(c("_keys")).alias("keys"), "focus_x", "focus_y", "faces", "inside", "main_inside", "center_inside",
    )


def center_at(keys: Column, t: Column) -> Column:
    """The middle of the window at a time: eased from key to key, the first before and the last after all; null without keys."""
    step = lambda acc, k: F.struct(
        F.when(acc["x"].isNull(), k["center"]).when(t <= acc["at"], acc["x"]).otherwise(_eased(acc, k, t)).alias("x"), k["at"].alias("at"), k["center"].alias("to")
    )
    none = F.lit(None).cast("double")
    return F.aggregate(keys, F.struct(none.alias("x"), none.alias("at"), none.alias("to")), step, lambda acc: acc["x"])


def _eased(before: Column, k: Column, t: Column) -> Column:
    u = F.least(F.lit(1.0), (t - before["at"]) / F.greatest(k["at"] - before["at"], F.lit(1e-9)))
    return before["to"] + (k["center"] - before["to"]) * u * u * (3 - 2 * u)


def summary(framings: DataFrame, by: list[str]) -> DataFrame:
    """For each group and mode: shots, faces, faces inside and inside a window in the middle, shots with faces, shots whose main face is inside."""
    return framings.groupBy(*by, "mode").agg(
        F.count("*").alias("shots"), F.sum("faces").alias("faces"), F.sum("inside").alias("inside"), F.sum("center_inside").alias("center_inside"),
        F.count("main_inside").alias("with_faces"), F.count_if("main_inside").alias("main_inside"),
    )
