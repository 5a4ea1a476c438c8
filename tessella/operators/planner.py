"""Planning of edits: slots on a beat grid, and clips assigned to slots.

The assignment is a fold: each choice depends on those before. It runs once
for each edit in ``applyInPandas``, many edits side by side, over all clips of
the edit's season as numpy columns; everything that does not depend on earlier
choices is a column before that. The clips of one season have to fit one task.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.music import source_offset

PLAN = "edit_id long, slot_no int, clip_id long, episode int, source_start double, aligned boolean, score double, crowd int"


def uniform_slots(beats: DataFrame, by: list[str], t: str, every: int, min_slot: float = 0.0) -> DataFrame:
    """Slots from every ``every``-th beat to the next such; a tail shorter than ``min_slot`` is merged into the slot before."""
    part = Window.partitionBy(*by)
    order = part.orderBy(t)
    grid = beats.select(*by, t).withColumns({"_i": F.row_number().over(order) - 1, "_end": F.max(t).over(part)}).where(F.col("_i") % every == 0)
    grid = grid.where((F.col(t) < F.col("_end")) & ((F.col("_end") - F.col(t) >= min_slot) | (F.col("_i") == 0)))
    cut = grid.withColumns({"end": F.coalesce(F.lead(t).over(order), F.col("_end")), "slot_no": (F.row_number().over(order) - 1).cast("int")})
    return cut.select(*by, "slot_no", F.col(t).alias("start"), "end")


def frame_counts(slots: DataFrame, by: list[str], fps: int = 30) -> DataFrame:
    """``slots`` with ``frames``: differences of the rounded boundaries, so that rounding never drifts."""
    order = Window.partitionBy(*by).orderBy("slot_no")
    at = F.bround(F.col("start") * fps)
    nxt = F.coalesce(F.lead(at).over(order), F.bround(F.col("end") * fps))
    return slots.withColumn("frames", (nxt - at).cast("long"))


def align_start(start: float, end: float, peak: float | None, length: float, hits: list[float]) -> tuple[float, bool]:
    """Where a clip has to begin so that its peak falls on a hit of the slot: the first hit for which it fits, else as near as it can; centred without a peak."""
    latest = max(start, end - length)
    if peak is None:
        return start + max(0.0, end - start - length) / 2, False
    for h in hits:
        if start - 1e-6 <= peak - h <= latest + 1e-6:
            return min(max(peak - h, start), latest), True
    return min(max(peak - (hits[0] if hits else 0.0), start), latest), False


def fullest_span(times: np.ndarray, at: float, window: float) -> int:
    """How many of ``times`` and ``at`` itself lie in the fullest span of length ``window`` that holds ``at``. Some fullest span begins at one of them."""
    near = np.sort(np.append(times[np.abs(times - at) <= window], at))
    begins = near[near <= at]
    return int((np.searchsorted(near, begins + window, side="right") - np.searchsorted(near, begins)).max())


def fullest_spans(times: np.ndarray, at: np.ndarray, window: float) -> np.ndarray:
    """``fullest_span`` for each of ``at``."""
    t = np.sort(times)
    begun = np.searchsorted(t, t + window, side="right") - np.searchsorted(t, t)
    holds = (t <= at[:, None]) & (at[:, None] - t <= window)
    from_own = np.searchsorted(t, at + window, side="right") - np.searchsorted(t, at)
    return np.maximum(np.where(holds, begun, 0).max(axis=1, initial=0), from_own) + 1


class _Edit:
    """What the choices of one edit share: the clips as columns, and what was chosen so far."""

    def __init__(self, clips: pd.DataFrame, needs: list[float], settings: dict):
        c = clips.sort_values("clip_id", kind="stable")
        self.s, self.slots = settings, len(needs)
        self.ids = c["clip_id"].to_numpy(np.int64)
        self.start, self.end, self.peak, self.rank, self.static = (c[k].to_numpy(float) for k in ("start", "end", "peak", "motion_rank", "static"))
        self.tier, self.in_pool = c["tier"].fillna(0).to_numpy(int), c["in_pool"].fillna(False).to_numpy(bool)
        self.cast = [frozenset(x) if x is not None else frozenset() for x in c["characters"]] if settings["same_character"] > 0 else []
        self.known = c["episode"].notna().to_numpy()
        self.episode = c["episode"].fillna(0).to_numpy(np.int64)
        self.episodes = len({*self.episode[self.known].tolist()})
        # The place of each clip in the season, by episode and time.
        self.place = np.empty(len(c), np.int64)
        self.place[np.lexsort((self.start, self.episode))] = np.arange(len(c))
        self.free, self.crowd, self.chosen = np.ones(len(c), bool), np.ones(len(c), np.int64), []
        self.latest = self.deadlines(needs)

    def deadlines(self, needs: list[float]) -> list[int]:
        """For each slot the last place from which every later slot still finds a long enough clip behind that of the slot before; slots for which there is none do not count."""
        size = np.empty(len(self.ids))
        size[self.place] = self.end - self.start
        found, last = [len(size)] * len(needs), len(size)
        for k in range(len(needs) - 1, -1, -1):
            fit = np.flatnonzero(size[:last] >= needs[k] - 1e-6)
            if len(fit):
                found[k] = last = int(fit[-1])
        return found

    def fitting(self, length: float) -> np.ndarray:
        """Clips that are long enough, unused ones if there are; else the longest."""
        fit = np.flatnonzero(self.end - self.start >= length - 1e-6)
        fresh = fit[self.free[fit]]
        return fresh if len(fresh) else fit if len(fit) else np.array([np.argmax(self.end - self.start)])

    def in_story(self, pool: np.ndarray, number: int) -> np.ndarray:
        """Clips behind the last one, as far ahead as the slot is in the edit and two slots more; enough of them stay for the slots to come, long enough for each."""
        last = self.place[self.chosen[-1]] if self.chosen else -1
        ahead = pool[self.place[pool] > last]
        ahead = ahead[np.argsort(self.place[ahead])]
        ahead = ahead[: max(1, len(ahead) - (self.slots - number - 1))]
        ahead = ahead[: max(1, np.count_nonzero(self.place[ahead] <= self.latest[number]))]
        near = ahead[self.place[ahead] * max(1, self.slots) < (number + 2) * len(self.ids)]
        return next((p for p in (near, ahead) if len(p)), pool)

    def repeated(self) -> frozenset:
        """Characters of every one of the last clips."""
        n = self.s["same_character"]
        return frozenset.intersection(*[self.cast[i] for i in self.chosen[-n:]]) if 0 < n <= len(self.chosen) else frozenset()

    def narrowed(self, pool: np.ndarray, slot: dict, number: int, story: bool) -> np.ndarray:
        """The pool after all wishes in order; one that would leave nothing is passed over."""

        def wish(pool: np.ndarray, test: np.ndarray) -> np.ndarray:
            return pool[test] if test.any() else pool

        if story:
            pool = self.in_story(pool, number)
        best = self.tier[pool].max()
        pool = wish(pool, self.tier[pool] >= best) if best > 0 else pool
        pool = wish(pool, self.in_pool[pool])
        if self.s["crowd"] > 0:
            pool = pool[self.crowd[pool] <= max(self.s["crowd"], self.crowd[pool].min())]
        tail = self.chosen[-self.s["run"] :] if self.s["run"] > 0 and not story else []
        if tail and len(tail) == self.s["run"] and self.known[tail].all() and len({*self.episode[tail].tolist()}) == 1:
            pool = wish(pool, (self.episode[pool] != self.episode[tail[0]]) | ~self.known[pool])
        again = self.repeated() - frozenset(self.s["characters"])
        if again:
            pool = wish(pool, np.array([not self.cast[i] & again for i in pool]))
        latest = self.end[pool] - slot["need"]
        fits = np.zeros(len(pool), bool)
        for h in slot["hits"]:
            at = self.peak[pool] - h
            fits |= (self.start[pool] - 1e-6 <= at) & (at <= latest + 1e-6)
        return wish(pool, fits)

    def scores(self, pool: np.ndarray, intensity: float) -> np.ndarray:
        s, own, known = self.s, self.episode[pool], self.known[pool]
        recent, before = self.chosen[-s["repeat"] :] if s["repeat"] > 0 else [], self.chosen

        def share(among: list[int]) -> np.ndarray:
            """How many of ``among`` are of the episode of each clip of the pool."""
            values, counts = np.unique(self.episode[among][self.known[among]], return_counts=True) if len(among) else ([], [])
            if not len(values):
                return np.zeros(len(own))
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            return np.where(values[at] == own, counts[at], 0)

        repeat = np.where(known, share(recent) / max(1, len(recent)), 0.0)
        fair = len(before) / max(1, self.episodes)
        over = np.clip((share(before) - fair) / (fair + 1), 0.0, 1.0) * (known & (self.episodes > 1) & (len(before) > 0))
        rank = np.nan_to_num(self.rank[pool], nan=0.5)
        return np.round(np.nan_to_num(self.static[pool]) + s["energy"] * (1 - np.abs(rank - intensity)) - s["w_repeat"] * repeat - s["w_overuse"] * over, 4)

    def take(self, i: int) -> int:
        """Marks a clip as used; how full the fullest span around it is with it."""
        crowd = int(self.crowd[i])
        self.chosen.append(int(i))
        self.free[i] = False
        own = [k for k in self.chosen if self.episode[k] == self.episode[i] and self.known[k] == self.known[i]]
        times = self.start[own]
        near = np.flatnonzero((self.episode == self.episode[i]) & (self.known == self.known[i]) & (np.abs(self.start - self.start[i]) <= self.s["window"]))
        self.crowd[near] = fullest_spans(times, self.start[near], self.s["window"])
        return crowd


def _fold(mode: str, settings: dict):
    def plan(key: tuple, slots: pd.DataFrame, clips: pd.DataFrame) -> pd.DataFrame:
        edit, rng, out = int(key[0]), random.Random(settings["seed"] + int(key[0])), []
        ordered = slots.sort_values("slot_no").to_dict("records") if len(clips) else []
        state = _Edit(clips, [float(s["need"]) for s in ordered], settings) if ordered else None
        for number, slot in enumerate(ordered):
            length, hits = float(slot["need"]), [float(h) for h in slot["hits"]]
            pool = state.fitting(length)
            if mode == "random":
                i, score = int(rng.choice(pool)), 0.0
                at, aligned = state.start[i] + rng.uniform(0.0, max(0.0, state.end[i] - state.start[i] - length)), False
            else:
                pool = state.narrowed(pool, {"need": length, "hits": hits}, number, mode == "story")
                total = state.scores(pool, float(slot["intensity"]))
                best = np.lexsort((state.ids[pool], -total))[: max(1, settings["top"])]
                pick = rng.choice(best.tolist())
                i, score = int(pool[pick]), float(total[pick])
                peak = None if np.isnan(state.peak[i]) else float(state.peak[i])
                at, aligned = align_start(float(state.start[i]), float(state.end[i]), peak, length, hits)
            crowd = state.take(i)
            episode = int(state.episode[i]) if state.known[i] else None
            out.append((edit, int(slot["slot_no"]), int(state.ids[i]), episode, float(at), bool(aligned), score, crowd))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])
        return made.astype({"episode": "Int32"})

    return plan


def assign(slots: DataFrame, clips: DataFrame, mode: str = "beats", **settings) -> DataFrame:
    """A clip for each slot of each edit.

    ``slots``: edit_id, slot_no, start, end, intensity, hits, and ``pieces``
    (array<struct<until, speed>>) where slots run slower or faster. ``clips``:
    edit_id, clip_id, episode, start, end, peak, motion_rank, ``static`` (the
    weighted parts of the score that no choice changes), ``tier`` (2 with all
    wanted characters, 1 with some, else 0), in_pool, characters.

    Every wish narrows the pool only if something is left: long enough, unused;
    in story order (``mode`` story) with room for the slots to come; the best
    tier of wanted characters; the style's pool; at most ``crowd`` clips of
    any span of ``window`` seconds, more only where all are fuller; not ``run``
    clips of one episode in a row (but in story order); no character, other
    than ``characters``, of all the last ``same_character`` clips; alignable.
    One of the ``top`` best by score is drawn. ``mode`` random takes any clip
    that fits, at any place. An edit without clips has no rows.
    """
    s = {"seed": 7, "window": 60.0, "crowd": 2, "run": 2, "same_character": 0, "characters": (), "repeat": 6, "energy": 1.0, "w_repeat": 0.3, "w_overuse": 0.3, "top": 8} | settings
    length = F.col("end") - F.col("start")
    need, hits = length, F.col("hits")
    if "pieces" in slots.columns:
        timed = F.coalesce(F.size("pieces"), F.lit(0)) > 0
        need = F.when(timed, source_offset(length, F.col("pieces"))).otherwise(length)
        hits = F.when(timed, F.transform("hits", lambda h: source_offset(h, F.col("pieces")))).otherwise(hits)
    asked = slots.select("edit_id", "slot_no", "intensity", need.alias("need"), hits.alias("hits"))
    return asked.groupBy("edit_id").cogroup(clips.groupBy("edit_id")).applyInPandas(_fold(mode, s), PLAN)
