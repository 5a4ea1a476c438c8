"""A library of songs against what is known of it: tags, what a run has to do, and what its songs are worth to suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranks

#: What a file tells of itself, and what a known song keeps of that.
TAGS = ("title", "artist", "album", "genres", "duration")
#: States of a track, in the order in which they are decided.
STATES = ("failed_before", "filtered", "wrong_length", "known", "todo", "pending")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def fill_tags(tracks: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """``tracks`` with the ``TAGS`` of the known song of the same path, if that has a title and the file is as it was (``size, mtime``).

    Tracks whose tags were read (``tagged``) keep their own. A tracks table has
    each path once, and so has ``known``; a null path meets nothing.
    """
    old = known.where(F.col("title").isNotNull()).select(key, *[F.col(c).alias(f"_{c}") for c in (*TAGS, "size", "mtime")], F.lit(True).alias("_met"))
    take = F.coalesce(F.col("_met") & ~F.coalesce("tagged", F.lit(False)) & _same(F.col("size"), F.col("_size")) & _same(F.col("mtime"), F.col("_mtime")), F.lit(False))
    joined = tracks.join(old, key, "left").withColumn("_take", take)
    filled = {c: F.when(F.col("_take"), F.col(f"_{c}")).otherwise(F.col(c)) for c in TAGS}
    return joined.withColumns({**filled, "tagged": F.col("_take") | F.coalesce("tagged", F.lit(False))}).select(*tracks.columns)


def matches(search: str | None = None, genre: str | None = None) -> Column:
    """Whether a track has ``search`` in artist, title, album or file name (joined by spaces), and ``genre`` in one of its genres; case does not count."""
    parts = [F.col("artist"), F.col("title"), F.col("album"), F.element_at(F.split("path", "/"), -1)]
    text = F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
    found = F.contains(text, F.lit(search.lower())) if search else F.lit(True)
    if not genre:
        return found
    return found & F.coalesce(F.exists("genres", lambda g: F.coalesce(F.contains(F.lower(g), F.lit(genre.lower())), F.lit(False))), F.lit(False))


def plan_run(
    tracks: DataFrame, known: DataFrame, failed: DataFrame, library: str, wanted: Column,
    limit: int | None = None, shortest: float = 45.0, longest: float = 720.0, force: bool = False, order: tuple[str, ...] = ("path",),
) -> DataFrame:
    """``tracks`` with ``status``, the first of ``STATES`` that holds, and ``retag``: a known song whose title or source id has changed.

    ``wanted`` says what a run looks for (see ``matches``). ``failed`` has the
    ``path, size, mtime`` of files that could not be read: one that is another
    file by now is tried again. A song is known if its row has an ``analysis``
    and a ``mood`` and its file is the same. Of those to do, the first
    ``limit`` of each library by ``order`` are done, the others pending; their
    places come from ranges, so a library of any size is no single task.
    ``force`` looks neither at failures nor at what is known.
    """
    file = ["path", "size", "mtime"]
    tried = failed.select(*file).distinct().withColumn("_failed", F.lit(True))
    rows = known.where(F.col("analysis").isNotNull() & F.col("mood").isNotNull()).select(*file, F.col("title").alias("_title"), F.col("source_id").alias("_source_id"), F.lit(True).alias("_known"))
    t = tracks.join(tried, file, "left").join(rows, file, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) & F.lit(not force)
    state = F.when(flag("_failed"), "failed_before").when(~wanted, "filtered").when(~F.coalesce(F.col("duration").between(shortest, longest), F.lit(True)), "wrong_length").when(flag("_known"), "known").otherwise("todo")
    retag = ~(_same(F.col("title"), F.col("_title")) & _same(F.col("source_id"), F.col("_source_id")))
    out = t.withColumn("status", state).withColumn("retag", (F.col("status") == "known") & retag).select(*tracks.columns, "status", "retag")
    if limit is None:
        return out
    todo = F.col("status") == "todo"
    placed = ranks.positions(out.withColumn("_todo", todo), [library, "_todo"], [F.col(c) for c in order])
    return placed.withColumn("status", F.when(todo & (F.col("_pos") >= limit), "pending").otherwise(F.col("status"))).select(*out.columns)


def report(planned: DataFrame, library: str) -> DataFrame:
    """A count of each of ``STATES``, of tracks ``found`` and of those to ``retag``, for each library."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    return planned.groupBy(library).agg(F.count("*").alias("found"), *counts, F.count_if("retag").alias("retag"))


def merge_songs(known: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """``known`` after a run: rows of ``done`` take the place of those with their key or are added; columns that ``done`` lacks stay as they were."""
    fresh = [c for c in done.columns if c != key]
    new = done.select(key, *[F.col(c).alias(f"_{c}") for c in fresh], F.lit(True).alias("_new"))
    value = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
    return known.join(new, key, "full").select(*map(value, known.columns))


def usable_songs(songs: DataFrame, library: str) -> tuple[DataFrame, DataFrame]:
    """Songs that suggestions may use, each content once, and the counts of the others for each library.

    ``songs``: ``path, title, source, mood, analysis, size, content`` (null
    where the file is gone; a hash of the content otherwise) and ``signals``,
    the names of what the mood was made from. Counted are ``no_mood`` (no mood
    or no analysis), ``missing``, ``copies`` and, of the usable, those
    ``measured_only`` (without the audio model). Of copies the one with a
    source stays, then with a title, then the shortest, then the least path.
    """
    state = F.when(F.col("mood").isNull() | F.col("analysis").isNull(), "no_mood").when(F.col("content").isNull(), "missing").otherwise("there")
    s = songs.withColumn("_state", state)
    better = F.struct(F.col("source").isNull().alias("a"), F.col("title").isNull().alias("b"), F.length("path").alias("c"), F.col("path").alias("d"))
    there = s.where("_state = 'there'")
    kept = there.groupBy(library, "size", "content").agg(F.min(better)["d"].alias("path"), F.count("*").alias("_n"))
    usable = there.join(kept.select(library, "path"), [library, "path"], "left_semi").drop("_state")
    model = F.coalesce(F.array_contains("signals", "model"), F.lit(False))
    parts = [
        s.groupBy(library).agg(F.count_if(F.col("_state") == "no_mood").alias("no_mood"), F.count_if(F.col("_state") == "missing").alias("missing")),
        kept.groupBy(library).agg(F.count("*").alias("songs"), F.sum(F.col("_n") - 1).alias("copies")),
        usable.groupBy(library).agg(F.count_if(~model).alias("measured_only")),
    ]
    counts = reduce(lambda a, b: a.join(b, library, "left"), parts)
    return usable, counts.na.fill(0, ["songs", "copies", "measured_only"])
