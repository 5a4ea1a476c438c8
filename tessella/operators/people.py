"""Characters of a season: found by name, counted, and their faces picked for a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import name_score, normalize_name, split_names
from tessella.operators.ranks import systematic_sample
from tessella.session import written

#: Parts into which the names of a season are dealt, so that no season is one task.
PARTS = 32
#: Roles in their order; others come after them.
ROLES = ("MAIN", "SUPPORTING", "BACKGROUND")


def find(searches: DataFrame, characters: DataFrame, season: str, search: str) -> DataFrame:
    """``season, search, character_id, name, score, place``: the characters that a name fits, the best first (``place`` from 0).

    Searches (``season``, ``search``) go to the characters (``season,
    character_id, name, role, position``) of their season: better names first
    (3 equal, 2 all words, 1 a part), then roles in their order, then
    ``position``, then ``character_id``. Each name is normalised once. Nulls,
    names without letters or digits and seasons that are only on one side find
    nothing. Equal searches count once.

    Searches meet the distinct names of their season, in ``PARTS`` parts of it;
    characters come in by their name afterwards.
    """
    asked = searches.select(season, search).distinct().withColumn("_q", normalize_name(F.col(search))).where("_q <> ''")
    known = written(characters.select(season, "character_id", "name", "role", "position").withColumn("_n", normalize_name(F.col("name"))).where("_n <> ''"), "characters")
    names = known.select(season, "_n").distinct().withColumn("_part", F.pmod(F.xxhash64("_n"), F.lit(PARTS)))
    dealt = asked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    named = dealt.join(names, [season, "_part"]).withColumn("score", name_score(F.col("_q"), F.col("_n"))).where("score > 0").select(season, search, "_n", "score")
    hits = named.join(known, [season, "_n"])
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0))
    order = Window.partitionBy(season, search).orderBy(F.desc("score"), F.when(role == 0, len(ROLES) + 1).otherwise(role), F.asc_nulls_last("position"), "character_id")
    return hits.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select(season, search, "character_id", "name", "score", "place")


def pick(requests: DataFrame, characters: DataFrame, season: str, request: str, text: str) -> DataFrame:
    """The character of each name of a list such as ``Ann, Bo``: ``season, request, position, search, character_id, status, others``.

    ``status``: ``found``; ``unknown`` if nothing fits; ``repeated`` if an
    earlier name of the list is the same character; ``empty``, in one row with
    nulls, for a list without names. ``others``: the next three that fit.
    """
    parts = requests.select(season, request, F.posexplode_outer(split_names(F.col(text), ",")).alias("position", "search"))
    hits = find(parts.where("search is not null"), characters, season, "search").where("place < 4")
    best = hits.groupBy(season, "search").agg(F.max(F.when(F.col("place") == 0, F.col("character_id"))).alias("character_id"), F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_all"))
    found = parts.join(best, [season, "search"], "left")
    again = F.row_number().over(Window.partitionBy(season, request, "character_id").orderBy("position")) > 1
    status = F.when(F.col("search").isNull(), "empty").when(F.col("character_id").isNull(), "unknown").when(again, "repeated").otherwise("found")
    others = F.transform(F.slice("_all", 2, 3), lambda x: x["name"])
    return found.select(season, request, "position", "search", "character_id", status.alias("status"), F.when(F.col("_all").isNull(), F.array().cast("array<string>")).otherwise(others).alias("others"))


def overview(characters: DataFrame, faces: DataFrame, season: str) -> DataFrame:
    """``season, character_id, name, role, clips, faces, mean``: in how many clips each character is, with how many faces and how surely.

    ``faces``: ``season, clip, character_id, probability``; unknown faces have a
    null ``character_id``. Characters without faces have 0, 0 and null. Faces
    are counted by clip first, so a character with many makes no hot task.
    """
    by_clip = faces.where("character_id is not null").groupBy(season, "character_id", "clip").agg(F.count("*").alias("_f"), F.sum("probability").alias("_p"), F.count("probability").alias("_c"))
    total = by_clip.groupBy(season, "character_id").agg(F.count("*").alias("clips"), F.sum("_f").alias("faces"), (F.sum("_p") / F.nullif(F.sum("_c"), F.lit(0))).alias("mean"))
    none = F.lit(0).cast("long")
    return characters.select(season, "character_id", "name", "role").join(total, [season, "character_id"], "left").select(season, "character_id", "name", "role", F.coalesce("clips", none).alias("clips"), F.coalesce("faces", none).alias("faces"), "mean")


def sheet(faces: DataFrame, season: str, top: int) -> DataFrame:
    """Faces for a sheet of each character, with ``place``: ``top`` of them, evenly from the surest to the least sure; of unknown ones the ``top`` highest.

    ``faces``: ``season, face_id, character_id, probability, height``; ties go by ``face_id``.
    """
    by = [season, "character_id"]
    ranked = faces.withColumn("_order", F.when(F.col("character_id").isNull(), -F.col("height")).otherwise(-F.col("probability")))
    order = [F.asc_nulls_last("_order"), F.col("face_id")]
    known = systematic_sample(ranked.where("character_id is not null").withColumn("_key", F.coalesce("_order", F.lit(float("inf")))), by, ["_key", "face_id"], top).drop("_key")
    w = Window.partitionBy(season).orderBy(*order)
    unknown = ranked.where("character_id is null").withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= top).drop("_at")
    chosen = known.unionByName(unknown)
    return chosen.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")).drop("_order")
