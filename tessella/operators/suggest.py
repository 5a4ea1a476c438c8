"""Which songs suit a style and the scenes of a season: five parts, their score, reasons and concerns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.music import tempo_factor, tempo_fit
from tessella.operators.fusion import MOODS, mood_match, profile_similarity, standout

PARTS = ("mood", "season", "tempo", "drop", "material")
#: From these on a part is a reason, below ``WEAK`` a concern.
GOOD, MOOD_GOOD, WEAK = 0.7, 0.6, 0.45


@dataclass(frozen=True)
class Style:
    """What a style asks of a song: moods from -1 to 1, a range of tempo or none, and how much it wants a drop (below 0: none)."""

    mood: dict[str, float]
    bpm: tuple[float, float] | None = None
    song_drop: float = 0.0
    weights: dict[str, float] = field(default_factory=lambda: {"mood": 1.0, "season": 0.5, "tempo": 0.5, "drop": 0.5, "material": 0.5})
    tempo_tolerance: float = 0.4
    halftime: float = 0.85
    drop_full: float = 0.4
    clips_per_cut: float = 2.0


def _range(style: Style) -> list[Column]:
    return [F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in style.bpm or (None, None)]


def _weights(style: Style) -> dict[str, Column]:
    """What each part weighs for this style: tempo only with a range, the drop by how much it is wanted, the season only with a profile."""
    w = style.weights | {"tempo": style.weights["tempo"] if style.bpm else 0.0, "drop": style.weights["drop"] * abs(style.song_drop)}
    return {k: F.lit(float(w[k])) if k != "season" else F.when(F.col("profile").isNotNull(), F.lit(float(w[k]))).otherwise(F.lit(0.0)) for k in PARTS}


def rate(songs: DataFrame, style: Style) -> DataFrame:
    """``songs`` with the five parts, ``factor`` and ``score``; parts have 3 digits, and so has the score.

    ``songs``: ``moods`` and ``profile`` (structs of the five moods; null moods
    count 0.5, a null profile has no part), ``bpm``, ``cuts`` of the edit,
    ``drop`` (the strength of the strongest in it, null without one) and
    ``pool``, how many clips the style has.
    """
    low, high = _range(style)
    level = F.least(F.lit(1.0), F.coalesce(F.col("drop_strength") / F.lit(style.drop_full), F.lit(0.0)))
    mood = {m: F.col("moods").getField(m) for m in MOODS}
    filled = lambda c: [F.coalesce(F.col(c).getField(m), F.lit(0.5)) for m in MOODS]
    parts = {
        "mood": F.round(mood_match(mood, style.mood), 3),
        "season": F.when(F.col("moods").isNull() | F.col("profile").isNull(), F.lit(0.5)).otherwise(profile_similarity(filled("moods"), filled("profile"))),
        "tempo": tempo_fit(F.col("bpm"), low, high, style.tempo_tolerance, style.halftime),
        "drop": F.round(level if style.song_drop >= 0 else F.lit(1.0) - level, 3),
        "material": F.round(F.least(F.lit(1.0), F.col("pool") / F.greatest(F.lit(1.0), F.col("cuts") * F.lit(style.clips_per_cut))), 3),
    }
    w = _weights(style)
    total = reduce(lambda a, b: a + b, w.values())
    out = songs.withColumnRenamed("drop", "drop_strength").withColumns(parts | {"factor": tempo_factor(F.col("bpm"), low, high)})
    score = reduce(lambda a, b: a + b, [w[k] * F.col(k) for k in PARTS])
    return out.withColumn("score", F.round(F.when(total > 0, score / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)), 3))


def explain(rated: DataFrame, style: Style) -> DataFrame:
    """``rated`` with ``reasons`` (3 at most) and ``concerns`` (2 at most), names of parts, those that weigh most first.

    A part that weighs nothing is neither. A song that stands out by the very
    moods of the season's scenes has one reason for both. A drop is a reason
    only where there is one and the style wants it, a concern where one is
    wanted and missing or unwanted and there; material is only ever a concern.
    """
    w, has_drop = _weights(style), F.col("drop_strength").isNotNull()
    own, scenes = (F.array_join(standout({m: F.col(c).getField(m) for m in MOODS}), ",") for c in ("moods", "profile"))
    speaks = F.col("profile").isNotNull() & (scenes != "")
    merged = speaks & (own == scenes) & (F.col("season") >= GOOD)
    yes, no = F.lit(True), F.lit(False)
    for_, against = (
        {"mood": yes, "season": speaks & ~merged, "tempo": yes, "drop": has_drop if style.song_drop > 0 else no, "material": no},
        {"mood": yes, "season": speaks, "tempo": yes, "drop": yes if style.song_drop > 0 else has_drop if style.song_drop < 0 else no, "material": yes},
    )

    def listed(weight, test, n: int) -> Column:
        found = F.array(*[F.struct((-weight(k)).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k"), (test(k) & (w[k] > 0)).alias("is")) for i, k in enumerate(PARTS)])
        return F.slice(F.transform(F.array_sort(F.filter(found, lambda x: x["is"])), lambda x: x["k"]), 1, n)

    good = lambda k: F.col(k) >= (MOOD_GOOD if k == "mood" else GOOD)
    return rated.withColumns(
        {
            "reasons": listed(lambda k: w[k] * F.col(k), lambda k: for_[k] & good(k), 3),
            "concerns": listed(lambda k: w[k] * (1 - F.col(k)), lambda k: against[k] & (F.col(k) < WEAK) & ~(for_[k] & good(k)), 2),
        }
    )


def suggest(rated: DataFrame, by: list[str], length: int, top: int = 5, per_artist: int = 2) -> DataFrame:
    """The best songs for each group ``by``: long enough for the edit, at most ``per_artist`` of one artist (case does not matter; songs without an artist are not counted), ``place`` from 1; ties by label."""
    fit = rated.where(F.col("duration") >= length).withColumns({"_artist": F.coalesce(F.lower("artist"), F.lit("")), "_label": F.lower("label")})
    order = [F.col("score").desc(), F.col("_label"), F.col("song")]
    if per_artist > 0:
        nth = F.row_number().over(Window.partitionBy(*by, "_artist").orderBy(*order))
        fit = fit.withColumn("_nth", nth).where((F.col("_nth") <= per_artist) | (F.col("_artist") == "")).drop("_nth")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return fit.withColumn("place", place.cast("long")).where(F.col("place") <= top).drop("_artist", "_label")
