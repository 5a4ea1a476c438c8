"""Finished edits: where their song starts, what choices cost, which moods they have, and their plans as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import fusion


def song_starts(requests: DataFrame, beats: DataFrame, song: str, request: str, t: str = "t") -> DataFrame:
    """``song, request, start, status`` for each request: ``length`` of a song of ``duration``, near ``wanted`` (null: the first beat).

    The start is the beat nearest to ``wanted`` (the earlier of two). Where the
    length does not fit behind it, it is the last beat with room, or 0. A song
    without beats, or shorter than the length, has no start and says so in
    ``status``; others are ``ok``.
    """
    length, duration, wanted, at = F.col("length"), F.col("duration"), F.col("wanted"), F.col(t)
    far = F.struct(F.abs(at - wanted).alias("d"), at.alias("t"))
    g = requests.join(beats.select(song, t), song, "left").groupBy(song, request, "length", "duration", "wanted").agg(
        F.min(at).alias("_first"), F.min(F.when(wanted.isNotNull() & at.isNotNull(), far))["t"].alias("_near"), F.max(F.when(at + length <= duration, at)).alias("_fits"),
    )
    status = F.when(F.col("_first").isNull(), "no beats").when(length > duration, "too short").otherwise("ok")
    start = F.coalesce("_near", "_first")
    start = F.when(start + length > duration, F.coalesce(F.col("_fits"), F.lit(0))).otherwise(start)
    return g.select(song, request, F.when(status == "ok", start).alias("start"), status.alias("status"))


def choices(chosen: DataFrame, edit: str, slot: str, window: int = 6) -> DataFrame:
    """``chosen`` with ``repeat`` and ``overuse``: how much each choice's ``episode`` was used before it in its edit.

    ``repeat`` is the share of the last ``window`` choices from the same
    episode. ``overuse`` is what that episode has over the mean of all
    ``episodes`` so far, over that mean and one, at most 1. An unknown episode
    (null) has neither, but counts as a choice. 3 digits.
    """
    order = Window.partitionBy(edit).orderBy(slot)
    own = Window.partitionBy(edit, "episode").orderBy(slot)
    earlier = F.collect_list(F.struct("episode")).over(order.rowsBetween(-window, -1))
    same = F.size(F.filter("_earlier", lambda x: x["episode"] == F.col("episode")))
    marked = chosen.withColumns({"_earlier": earlier, "_total": F.row_number().over(order) - 1, "_own": F.row_number().over(own) - 1})
    fair = F.col("_total") / F.col("episodes")
    over = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_own") - fair) / (fair + 1.0))
    counted = F.col("episode").isNotNull() & (F.col("_total") > 0)
    return marked.withColumns(
        {
            "repeat": F.round(F.when(counted & (F.size("_earlier") > 0), same / F.nullif(F.size("_earlier"), F.lit(0))).otherwise(F.lit(0.0)), 3),
            "overuse": F.round(F.when(counted & (F.col("episodes") > 1), over).otherwise(F.lit(0.0)), 3),
        }
    ).drop("_earlier", "_total", "_own")


def character_match(found: Column, wanted: Sequence[int]) -> Column:
    """The mean certainty (map ``found``) of the ``wanted`` characters; absent ones, and a null map, count 0."""
    if not wanted:
        return F.lit(0.0)
    sure = F.aggregate(F.array(*[F.lit(w).cast("long") for w in wanted]), F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(found, w), F.lit(0.0)))
    return sure / len(wanted)


def scored(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``df`` with ``score``: its parts ``mood, energy, character, quality`` less ``repeat, dialog, overuse``, by ``weights``; 4 digits.

    Missing parts are neutral: 0.5 for mood, 1 for quality, 0 for the others. A
    part that has no weight counts nothing.
    """
    neutral = {"mood": 0.5, "energy": 0.0, "character": 0.0, "quality": 1.0, "repeat": 0.0, "dialog": 0.0, "overuse": 0.0}
    if unknown := set(weights) - set(neutral):
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    total = F.lit(0.0)
    for part, w in weights.items():
        value = F.coalesce(F.col(part).cast("double"), F.lit(neutral[part])) * F.lit(float(w))
        total = total - value if part in ("repeat", "dialog", "overuse") else total + value
    return df.withColumn("score", F.round(total, 4))


def edit_moods(chosen: DataFrame, by: Sequence[str], moods: Sequence[str]) -> DataFrame:
    """``by, mood, average, strongest``: the mean of each mood over the clips of an edit that have moods, and of how many it is the strongest. 4 digits."""
    has = chosen.where(" or ".join(f"`{m}` is not null" for m in moods))
    top = fusion.dominant({m: F.col(m) for m in moods})
    g = has.withColumn("_top", top).groupBy(*by).agg(*[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in moods], *[F.count_if(F.col("_top") == m).alias(f"_{m}") for m in moods])
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("mood"), F.round(m, 4).alias("average"), F.col(f"_{m}").alias("strongest")) for m in moods]))
    return g.select(*by, rows)


def style_fit(chosen: DataFrame, season: DataFrame, by: Sequence[str], season_by: str, target: dict[str, float]) -> DataFrame:
    """How well an edit and its whole season fit a style: the mean ``mood_match`` of the clips with moods. ``by`` holds ``season_by``. 4 digits."""
    fit = fusion.mood_match({m: F.col(m) for m in target}, target)
    has = " or ".join(f"`{m}` is not null" for m in target)
    inside = chosen.where(has).groupBy(*by).agg(F.round(F.avg(fit), 4).alias("in_edit"))
    return inside.join(season.where(has).groupBy(season_by).agg(F.round(F.avg(fit), 4).alias("in_season")), season_by)


def plans(edits: DataFrame, clips: DataFrame, edit: str, slot: str) -> DataFrame:
    """``edit`` and ``plan``: the columns of each edit and its clips by slot, as one JSON value; nulls are written.

    All clips of one edit have to fit one value, as the format asks for. An
    edit without clips has an empty list; clips of unknown edits are left out.
    """
    parts = [c for c in clips.columns if c != edit]
    row = F.struct(F.col(slot).alias("_slot"), F.struct(*parts).alias("clip"))
    listed = clips.groupBy(edit).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["clip"]).alias("clips"))
    none = F.array().cast(listed.schema["clips"].dataType)
    whole = edits.join(listed, edit, "left").withColumn("clips", F.coalesce("clips", none))
    return whole.select(edit, F.to_json(F.struct(*edits.columns, "clips"), {"ignoreNullFields": "false"}).alias("plan"))
