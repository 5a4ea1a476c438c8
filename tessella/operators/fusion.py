"""Fusion of signals into moods and scores. Null means not measured: it is left out of means and becomes neutral only where a score is made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOODS = ("romance", "action", "sad", "funny", "calm")


def weighted_mean(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the signals that are there; 0.5 without any, 3 digits."""
    if unknown := set(weights) - set(signals):
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    total = reduce(lambda a, b: a + b, [F.coalesce(signals[k] * F.lit(float(w)), F.lit(0.0)) for k, w in weights.items()])
    share = reduce(lambda a, b: a + b, [F.when(signals[k].isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for k, w in weights.items()])
    return F.round(F.when(share > 0, total / F.nullif(share, F.lit(0.0))).otherwise(F.lit(0.5)), 3)


def mood_match(moods: dict[str, Column], target: dict[str, float]) -> Column:
    """How well moods fit a target of weights from -1 to 1, as 0 to 1. A missing mood counts 0.5, an empty target gives 0.5."""
    up, down = sum(w for w in target.values() if w > 0), -sum(w for w in target.values() if w < 0)
    if up + down == 0:
        return F.lit(0.5)
    dot = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.coalesce(moods[m], F.lit(0.5)) for m, w in target.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + F.lit(float(down))) / F.lit(float(up + down))))


def standout(moods: dict[str, Column], count: int = 2) -> Column:
    """Names of the moods above the row's own mean, strongest first, ties in the order given."""
    filled = {m: F.coalesce(c, F.lit(0.5)) for m, c in moods.items()}
    mean = reduce(lambda a, b: a + b, filled.values()) / len(filled)
    entries = F.array(*[F.struct((-c).alias("v"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, (m, c) in enumerate(filled.items())])
    return F.slice(F.transform(F.array_sort(F.filter(entries, lambda x: -x["v"] > mean)), lambda x: x["m"]), 1, count)


def dominant(moods: dict[str, Column]) -> Column:
    """The strongest mood, the first of several."""
    filled = [(m, F.coalesce(c, F.lit(-1.0))) for m, c in moods.items()]
    best = F.greatest(*[c for _, c in filled])
    return reduce(lambda acc, x: acc.when(x[1] == best, x[0]), filled[1:], F.when(filled[0][1] == best, filled[0][0]))


def profile_similarity(a: list[Column], b: list[Column]) -> Column:
    """(1 + Pearson) / 2 of two profiles; 0.5 if either is flat. 3 digits."""
    n = len(a)
    ma, mb = (reduce(lambda x, y: x + y, v) / n for v in (a, b))
    dot = reduce(lambda x, y: x + y, [(p - ma) * (q - mb) for p, q in zip(a, b)])
    na, nb = (reduce(lambda x, y: x + y, [(p - m) * (p - m) for p in v]) for v, m in ((a, ma), (b, mb)))
    norm = F.sqrt(na * nb)
    return F.round(F.when(norm > 1e-12, (F.lit(1.0) + dot / F.nullif(norm, F.lit(0.0))) / 2).otherwise(F.lit(0.5)), 3)


def quality(darkest: Column, brightest: Column, contrast: Column, sharpness: Column, typical: Column, prompts: dict[str, Column] | None = None, threshold: float = 0.5) -> Column:
    """(score, issue) of a clip, by the first rule that holds: dark, bright, flat, a group of ``prompts``, blurry, fine.

    ``prompts`` are probabilities of faults; the greatest (the first of
    several) counts from ``threshold`` on. Below it they take up to half the
    score of a fine clip, by their sum. Null means not measured.
    """
    case = F.when(brightest < 0.06, F.struct(F.lit(0.0).alias("score"), F.lit("dark").alias("issue")))
    case = case.when(darkest > 0.95, F.struct(F.lit(0.0).alias("score"), F.lit("bright").alias("issue")))
    case = case.when(contrast < 0.03, F.struct(F.lit(0.0).alias("score"), F.lit("flat").alias("issue")))
    fine = F.lit(1.0)
    if prompts:
        known = {g: F.coalesce(p, F.lit(0.0)) for g, p in prompts.items()}
        worst = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i"), F.lit(g).alias("g")) for i, (g, p) in enumerate(known.items())]))
        case = case.when(worst["p"] >= threshold, F.struct(F.lit(0.0).alias("score"), worst["g"].alias("issue")))
        share = reduce(lambda a, b: a + b, known.values()) / max(threshold, 1e-6)
        fine = F.round(F.greatest(F.lit(0.5), 1.0 - 0.5 * F.least(F.lit(1.0), share)), 3)
    case = case.when(sharpness < typical * 0.2, F.struct(F.lit(0.2).alias("score"), F.lit("blurry").alias("issue")))
    return case.otherwise(F.struct(fine.alias("score"), F.lit(None).cast("string").alias("issue")))


def dialog_flag(subtitle: Column, speech: Column, least: float = 0.3) -> Column:
    """Whether somebody speaks; null if neither signal was measured."""
    said = F.coalesce(subtitle != "", F.lit(False)) | F.coalesce(speech >= least, F.lit(False))
    return F.when(subtitle.isNull() & speech.isNull(), None).otherwise(said)


def static_score(mood: Column, motion_rank: Column, intensity: Column, character: Column, quality_: Column, dialog: Column, w: dict[str, float]) -> Column:
    """The part of a clip's score that does not depend on what was chosen before."""
    return (
        F.lit(w["mood"]) * F.coalesce(mood, F.lit(0.5)) + F.lit(w["energy"]) * (F.lit(1.0) - F.abs(F.coalesce(motion_rank, F.lit(0.5)) - intensity))
        + F.lit(w["character"]) * F.coalesce(character, F.lit(0.0)) + F.lit(w["quality"]) * F.coalesce(quality_, F.lit(1.0)) - F.lit(w["dialog"]) * F.coalesce(dialog.cast("double"), F.lit(0.0))
    )


def average_tags(df: DataFrame, key: str, line: str, weight: str, tags: str) -> DataFrame:
    """Mean of tag maps, weighted: absent tags count 0, and no weight at all gives no row. 4 digits, half up, by exact sums (weights and shares of up to 4 digits)."""
    exact = lambda c: c.cast("decimal(18,4)")
    total = df.groupBy(key).agg(F.sum(exact(F.col(weight))).cast("decimal(24,4)").alias("_total")).where("_total > 0")
    parts = df.select(key, line, weight, F.explode(tags).alias("tag", "p")).groupBy(key, "tag").agg(F.sum(exact(F.col(weight)) * exact(F.col("p"))).cast("decimal(28,8)").alias("_sum"))
    return parts.join(total, key).select(key, "tag", (F.expr("(_sum * 20000 + _total) div (2 * _total)") / 10000).alias("p"))
