"""The catalogue's changes as set operations: upserts, replaced children, caches, ledgers, stage signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import signature


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row with the greatest version for each key (a cache where the last write wins)."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(version).desc()))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def upsert_seasons(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Seasons after a scan. Rows have ``key, title, number, anilist_id, done``; a changed title or number drops the id and the mark of completeness; rows without news stay."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh, gone = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    changed = ~fresh & ~gone & ~(F.col("o.title").eqNullSafe(F.col("n.title")) & F.col("o.number").eqNullSafe(F.col("n.number")))
    pick = lambda c: F.when(gone, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return j.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), pick("title"), pick("number"),
        F.when(changed | fresh, None).otherwise(F.col("o.anilist_id")).alias("anilist_id"), (~changed & ~fresh & F.coalesce(F.col("o.done"), F.lit(False))).alias("done"),
    )


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children after the parents in ``new`` were written again; those of other parents stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows that a ledger of failures does not list."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")


def without_copies(df: DataFrame, size: str, content: str, *preference: str) -> DataFrame:
    """One row for each content, the first by ``preference``. Rows are told apart by size and hash, so contents do not travel."""
    hashed = df.withColumn("_h", F.sha1(F.col(content).cast("binary")))
    narrow = hashed.select(size, "_h", *preference)
    at = F.row_number().over(Window.partitionBy(size, "_h").orderBy(*preference))
    return narrow.withColumn("_at", at).where("_at = 1").select(*preference, size, F.col("_h").alias("hash"))


def triage(df: DataFrame, key: str, rules: list[tuple[str, object]], otherwise: str) -> DataFrame:
    """``df`` with ``status``: the name of the first rule (condition) that holds."""
    case = None
    for name, condition in rules:
        case = F.when(condition, name) if case is None else case.when(condition, name)
    return df.withColumn("status", case.otherwise(otherwise))


def stage_signatures(df: DataFrame, source: list[str], stages: list[tuple[str, list[str], str]]) -> DataFrame:
    """``df`` with a signature column for each stage (name, upstream signature columns, settings): a change of the source, the settings or upstream changes it."""
    out = df.withColumn("source_signature", signature(*[F.col(c) for c in source]))
    for name, upstream, settings in stages:
        out = out.withColumn(name, signature(*[F.col(c) for c in (upstream or ["source_signature"])], F.lit(settings)))
    return out


def worklist(now: DataFrame, stored: DataFrame, key: str, signature_column: str) -> DataFrame:
    """Rows whose stored signature is missing or another."""
    s = stored.select(key, F.col(signature_column).alias("_stored"))
    return now.join(s, key, "left").where(~F.col(signature_column).eqNullSafe(F.col("_stored"))).drop("_stored")


def group_signature(df: DataFrame, by: str, child: str) -> DataFrame:
    """One signature for each parent over its children's, in sorted order."""
    joined = F.array_join(F.array_sort(F.collect_list(F.coalesce(child, F.lit("")))), "|")
    return df.groupBy(by).agg(signature(joined).alias("signature"))
