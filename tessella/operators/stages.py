"""The stages of an index: what a run has to do again, pushed along the graph of stages, and the tables after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import signature

DIGITS = 12  # hexadecimal digits of a signature that the sum over a season takes


@dataclass(frozen=True)
class Stage:
    name: str
    upstream: tuple[str, ...] = ()  # names of earlier stages, or columns of the episode
    settings: str = ""
    whole: bool = False  # over all episodes of a season at once


def reset_changed(episodes: DataFrame, before: DataFrame, after: DataFrame, season: str, id: str, *marks: str) -> DataFrame:
    """Episodes with the columns ``marks`` null where the ``id`` of their season was set before and is another or none now.

    A season seen for the first time, or given its first id, resets nothing;
    nor does one that ``after`` does not have. Seasons are told apart by
    ``season``, of which each table has one row.
    """
    b = before.select(season, F.col(id).alias("_was")).where(F.col("_was").isNotNull())
    changed = b.join(after.select(season, F.col(id).alias("_is")), season).where(~F.col("_was").eqNullSafe(F.col("_is"))).select(season, F.lit(True).alias("_changed"))
    keep = lambda c: F.when(F.col("_changed").isNull(), F.col(c)).alias(c)
    return episodes.join(changed, season, "left").select(*[keep(c) if c in marks else F.col(c) for c in episodes.columns])


def signatures(episodes: DataFrame, key: str, season: str, stages: list[Stage]) -> DataFrame:
    """``key, season`` and a signature for each stage, in the order given, so upstream stages come first.

    A stage's signature is made of those of its upstream and of its settings, so
    a change reaches everything below it and nothing else. That of a stage over
    whole seasons takes a sum over the episodes' signatures, with their keys,
    which is gathered before rows travel; later stages may build on it again.
    Null upstream columns count as null, so that setting one to null is a change.
    """
    out = episodes
    for s in stages:
        own = signature(*[F.col(c) for c in s.upstream], F.lit(s.settings))
        if s.whole:
            of = signature(F.col(key), *[F.col(c) for c in s.upstream])
            total = out.groupBy(season).agg(F.count("*").alias("_n"), F.sum(_number(of)).alias("_sum")).select(season, signature(F.col("_n"), F.col("_sum"), F.lit(s.settings)).alias(s.name))
            out = out.join(total.withColumnRenamed(season, "_season"), out[season].eqNullSafe(F.col("_season"))).drop("_season")
        else:
            out = out.withColumn(s.name, own)
    return out.select(key, season, *[s.name for s in stages])


def _number(signed: Column) -> Column:
    return F.conv(F.substring(signed, 1, DIGITS), 16, 10).cast("decimal(20,0)")


def advance(now: DataFrame, stored: DataFrame, key: str, season: str, stages: list[Stage]) -> DataFrame:
    """The table of episodes after a run: ``key, season``, the stages' signatures and ``stale``, the stages that had to run, in their order.

    ``stored`` is what the run before left (``key, season``, signatures). A stage
    is stale where its stored signature is missing or another. Episodes that
    ``now`` does not have keep their row and have nothing stale; so a second run
    over its own result changes no row. One merge writes all stages.
    """
    names = [s.name for s in stages]
    fresh = signatures(now, key, season, stages).withColumn("_now", F.lit(True))
    old = stored.select(F.col(key), F.col(season).alias("_season"), *[F.col(n).alias(f"_{n}") for n in names])
    j = fresh.join(old, key, "full_outer")
    stale = F.filter(F.array(*[F.when(F.col("_now") & ~F.col(n).eqNullSafe(F.col(f"_{n}")), n) for n in names]), lambda x: x.isNotNull())
    pick = lambda n, was: F.when(F.col("_now"), F.col(n)).otherwise(F.col(was)).alias(n)
    return j.select(key, pick(season, "_season"), *[pick(n, f"_{n}") for n in names], stale.alias("stale"))


def workload(advanced: DataFrame, season: str, stages: list[Stage]) -> DataFrame:
    """For each season and stage that has to run: how often. Stages over whole seasons run once."""
    whole = [s.name for s in stages if s.whole]
    runs = advanced.select(season, F.explode("stale").alias("stage")).groupBy(season, "stage").agg(F.count("*").alias("n"))
    return runs.withColumn("n", F.when(F.col("stage").isin(whole), F.lit(1).cast("long")).otherwise(F.col("n"))) if whole else runs


def write_skips(known: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Skipped spans after a run, and for each searched episode where its spans are from (``key, skips_source``).

    ``found``: ``key, kind, start, end, source`` of every searched episode; a row
    with a null ``kind`` says that the search had no result. Spans of searched
    episodes are replaced, others stay. Sources (each perhaps several, joined by ``+``)
    are joined by ``+`` in alphabetical order, ``none`` without any.
    """
    parts = F.when(F.col("kind").isNotNull(), F.split("source", "\\+"))
    searched = found.groupBy(key).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts)))), "+").alias("_s"))
    source = searched.select(key, F.when(F.col("_s") == "", "none").otherwise(F.col("_s")).alias("skips_source"))
    rows = known.join(searched.select(key), key, "left_anti").unionByName(found.where("kind is not null").select(*known.columns), allowMissingColumns=True)
    return rows, source


def prepare_episodes(stored: DataFrame, found: DataFrame, meta: DataFrame, season: str, number: str, marks: tuple[str, ...], resets: tuple[str, ...], force: bool = False) -> DataFrame:
    """The episodes after a look at their files, with ``work`` (``ready``, ``known``, ``missing``, or null if none was found) and whether its first stage ``marks[0]`` is ``open``.

    ``stored`` has ``season, number, title, filler, recap, source_id, path,
    size, mtime`` and stages, ``found`` ``title, source_id, path, size, mtime``
    (path null: not here), ``meta`` ``title, filler, recap``; each table has an
    episode once. A title comes from ``found``, else ``meta``, else stays.

    An episode with a file is ``ready``: its file is entered, and where that is
    another than before the stages ``resets`` become null; ``force`` opens the
    first stage. Without one it is ``known`` if all ``marks`` are set (and not
    ``force``), else ``missing``, and a missing one is not added. Rows of
    ``stored`` that were not found stay as they are.
    """
    key = [season, number]
    f = found.select(*key, *[F.col(c).alias(f"_{c}") for c in ("title", "source_id", "path", "size", "mtime")], F.lit(True).alias("_found"))
    m = meta.select(*key, *[F.col(c).alias(f"_meta_{c}") for c in ("title", "filler", "recap")], F.lit(True).alias("_told"))
    old = stored.withColumn("_stored", F.lit(True))
    x = old.join(f, key, "full").join(m, key, "left")
    done = F.lit(not force)
    for c in marks:
        done = done & F.col(c).isNotNull()
    ready = F.col("_found") & F.col("_path").isNotNull()
    work = F.when(ready, "ready").when(F.col("_found") & done, "known").when(F.col("_found"), "missing")
    changed = F.col("size").isNotNull() & ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")))
    told = F.coalesce(F.col("_found") & F.col("_told"), F.lit(False))
    new = {
        "title": F.when(F.col("_found"), F.coalesce("_title", "_meta_title", "title")).otherwise(F.col("title")),
        "filler": F.when(told, F.col("_meta_filler")).otherwise(F.col("filler")), "recap": F.when(told, F.col("_meta_recap")).otherwise(F.col("recap")),
        "source_id": F.coalesce("_source_id", "source_id"), **{c: F.when(F.col("_work") == "ready", F.col(f"_{c}")).otherwise(F.col(c)) for c in ("path", "size", "mtime")},
    }
    emptied = {c: F.when(F.coalesce((F.col("_work") == "ready") & F.col("_changed"), F.lit(False)), None).otherwise(F.col(c)) for c in resets}
    if force:
        emptied[marks[0]] = F.when(F.coalesce(F.col("_work") == "ready", F.lit(False)), None).otherwise(F.col(marks[0]))
    y = x.withColumns({"_work": work, "_changed": changed}).where("_stored or _work = 'ready'").withColumns({**new, **emptied})
    return y.select(*stored.columns, F.col("_work").alias("work"), F.coalesce((F.col("_work") == "ready") & F.col(marks[0]).isNull(), F.lit(False)).alias("open"))
