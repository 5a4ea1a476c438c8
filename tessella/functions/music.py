"""Tempo, rate and timing arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ramp(bars: int, start: Column, end: Column) -> Column:
    """array<double>: geometric steps from ``start`` to ``end`` over so many bars, each snapped to a power of two; a single bar has ``end``."""
    last = max(1, bars - 1)
    steps = F.sequence(F.lit(0), F.lit(bars - 1))
    value = lambda k: F.pow(F.lit(2.0), F.bround(F.log2(start * F.pow(end / start, k / F.lit(float(last))))))
    return F.array(F.pow(F.lit(2.0), F.bround(F.log2(end)))) if bars == 1 else F.transform(steps, value)


def tempo_distance(bpm: Column, low: Column, high: Column) -> Column:
    """By what factor a tempo lies outside a wanted range: 1 inside, 1.2 for a fifth too slow or too fast."""
    return F.when(bpm < low, low / F.nullif(bpm, F.lit(0.0))).when(bpm > high, bpm / high).otherwise(F.lit(1.0))


def tempo_factor(bpm: Column, low: Column, high: Column) -> Column:
    """1, 2 or 0.5: by what a tempo is divided to come nearest to a range (2 counts in half time). 1 before 2 before 0.5; 1 without a range or tempo."""
    d = [F.round(tempo_distance(bpm / F.lit(f), low, high), 6) for f in (1.0, 2.0, 0.5)]
    best = F.least(*d)
    none = low.isNull() | high.isNull() | bpm.isNull() | (bpm <= 0)
    return F.when(none | (d[0] == best), F.lit(1.0)).when(d[1] == best, F.lit(2.0)).otherwise(F.lit(0.5))


def tempo_fit(bpm: Column, low: Column, high: Column, tolerance: float = 0.4, halftime: float = 0.85) -> Column:
    """1 inside the range, falling to 0 at ``tolerance`` outside it; times ``halftime`` where the tempo was doubled or halved. 1 without a range or tempo; 3 digits."""
    f = tempo_factor(bpm, low, high)
    fit = F.greatest(F.lit(0.0), F.lit(1.0) - (tempo_distance(bpm / f, low, high) - 1) / F.lit(max(1e-6, tolerance)))
    none = low.isNull() | high.isNull() | bpm.isNull() | (bpm <= 0)
    return F.when(none, F.lit(1.0)).otherwise(F.round(fit * F.when(f == 1.0, F.lit(1.0)).otherwise(F.lit(halftime)), 3))


def source_offset(t: Column, pieces: Column) -> Column:
    """Source seconds that pass in ``t`` seconds of edit over pieces (array<struct<until, speed>>, the last extended)."""
    step = lambda acc, p: F.struct(
        (acc["out"] + F.greatest(F.lit(0.0), F.least(t, p["until"]) - acc["at"]) * p["speed"]).alias("out"), p["until"].alias("at"), p["speed"].alias("speed")
    )
    start = F.struct(F.lit(0.0).alias("out"), F.lit(0.0).alias("at"), F.lit(1.0).alias("speed"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"] + F.greatest(F.lit(0.0), t - acc["at"]) * acc["speed"])


def edit_offset(x: Column, pieces: Column) -> Column:
    """The inverse of ``source_offset``."""
    step = lambda acc, p: F.struct(
        (acc["out"] + F.greatest(F.lit(0.0), F.least((x - acc["src"]) / p["speed"], p["until"] - acc["at"]))).alias("out"),
        p["until"].alias("at"), (acc["src"] + (p["until"] - acc["at"]) * p["speed"]).alias("src"), p["speed"].alias("speed"),
    )
    start = F.struct(F.lit(0.0).alias("out"), F.lit(0.0).alias("at"), F.lit(0.0).alias("src"), F.lit(1.0).alias("speed"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"] + F.greatest(F.lit(0.0), x - acc["src"]) / acc["speed"])


def window_starts(duration: Column, count: int, length: float) -> Column:
    """array<double>: starts of evenly spaced windows inside the middle 80 % of a duration, 3 digits.

    One window lies in the middle; so does the only one where the middle is too
    short for two. A duration of at most one window has the start 0, none has no start.
    """
    first, last = duration * 0.1, duration * 0.9 - F.lit(length)
    if count < 1:
        return F.array().cast("array<double>")
    even = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.round(first + (last - first) * k / F.lit(float(max(1, count - 1))), 3))
    middle = F.array(F.round((first + last) / 2, 3))
    return (
        F.when(duration <= 0, F.array().cast("array<double>")).when(duration <= length, F.array(F.lit(0.0)))
        .when(last <= first, F.array((duration - F.lit(length)) / 2)).otherwise(middle if count == 1 else even)
    )


def smoothstep(x: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return u * u * (F.lit(3.0) - F.lit(2.0) * u)


def apply_look(r: Column, g: Column, b: Column, warmth: float = 0.0, tint: float = 0.0, saturation: float = 1.0, contrast: float = 1.0, brightness: float = 0.0, lift: float = 0.0) -> list[Column]:
    """Graded colour: gains by warmth and tint, saturation around luma, contrast around the middle, brightness; clipped to 0 and 1, then lifted."""
    gains = (1 + 0.15 * warmth + 0.05 * tint, 1 + 0.03 * warmth - 0.1 * tint, 1 - 0.15 * warmth + 0.05 * tint)
    r, g, b = (c * F.lit(k) for c, k in zip((r, g, b), gains))
    luma = F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b

    def channel(c: Column) -> Column:
        c = luma + (c - luma) * F.lit(saturation)
        c = (c - F.lit(0.5)) * F.lit(contrast) + F.lit(0.5) + F.lit(brightness)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(lift) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * F.lit(1 - lift)))

    return [channel(c) for c in (r, g, b)]


def scaled_mean(weights: dict[str, float], ranges: dict[str, tuple[float, float]]) -> Column:
    """The weighted mean of measured columns, each scaled from its range to 0 to 1 and cut there (those without a range as they are), 3 digits; 0.5 without weight above 0."""
    used = {k: w for k, w in weights.items() if w > 0}
    if not used:
        return F.lit(0.5)
    unit = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(k) - ranges[k][0]) / (ranges[k][1] - ranges[k][0]))) if k in ranges else F.col(k)
    total = F.lit(0.0)
    for k, w in used.items():
        total = total + unit(k) * w
    return F.round(total / sum(used.values()), 3)


def place_fit(arousal: Column, valence: Column, at: tuple[float, float], spread: float) -> Column:
    """How near a song is to the place of a mood: 1 there, falling with the square of the distance; 3 digits."""
    d = (arousal - at[0]) * (arousal - at[0]) + (valence - at[1]) * (valence - at[1])
    return F.round(F.exp(-d / (2 * spread * spread)), 3)


def describe(arousal: Column, valence: Column) -> Column:
    """Words for a place: ``calm``, ``medium tempo`` or ``energetic``, and ``rather sad``, ``neutral`` or ``rather happy``; null for null."""
    energy = F.when(arousal < 0.35, "calm").when(arousal > 0.65, "energetic").when(arousal.isNotNull(), "medium tempo")
    mood = F.when(valence < 0.4, "rather sad").when(valence > 0.6, "rather happy").when(valence.isNotNull(), "neutral")
    return F.concat(energy, F.lit(", "), mood)
