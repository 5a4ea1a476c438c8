"""Media entries from JSON payloads, the best match of a search, and chains of sequels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import written

#: Formats that are seasons of a series.
SEASON_FORMATS = ("TV", "TV_SHORT", "ONA")
#: What is read of a payload.
MEDIA = (
    "id long, idMal long, format string, episodes int, title struct<romaji string, english string, native string>, synonyms array<string>, genres array<string>, "
    "tags array<struct<name string, rank int>>, relations struct<edges array<struct<relationType string, node struct<id long, type string, format string>>>>, "
    "characters struct<edges array<struct<role string, node struct<id long, name struct<full string>, image struct<large string>>>>>"
)


def parse_media(payload: Column) -> Column:
    """A payload as a struct: ids, the English title (else romaji, else the id), all titles, genres, tags, characters and ``sequel_id``.

    The sequel is the first relation to a season of the same kind. Null where the payload is no JSON.
    """
    # Each payload is read once, however many fields are taken from it.
    return F.transform(F.array(F.from_json(payload, MEDIA)), _entry)[0]


def _entry(m: Column) -> Column:
    named = lambda c: F.when(F.length(c) > 0, c)
    titles = F.filter(F.concat(F.array(m["title"]["romaji"], m["title"]["english"], m["title"]["native"]), F.coalesce(m["synonyms"], F.array().cast("array<string>"))), lambda t: F.length(t) > 0)
    after = lambda e: (e["relationType"] == "SEQUEL") & (e["node"]["type"] == "ANIME") & e["node"]["format"].isin(*SEASON_FORMATS)
    people = F.transform(m["characters"]["edges"], lambda e: F.struct(e["node"]["id"].alias("id"), e["node"]["name"]["full"].alias("name"), e["role"].alias("role"), e["node"]["image"]["large"].alias("image_url")))
    return F.when(
        m["id"].isNotNull(),
        F.struct(
            m["id"].alias("id"), m["idMal"].alias("mal_id"), F.coalesce(named(m["title"]["english"]), named(m["title"]["romaji"]), m["id"].cast("string")).alias("title"), titles.alias("titles"),
            m["format"].alias("format"), m["episodes"].alias("episodes"), F.coalesce(m["genres"], F.array().cast("array<string>")).alias("genres"), m["tags"].alias("tags"),
            people.alias("characters"), F.get(F.filter(m["relations"]["edges"], after), F.lit(0))["node"]["id"].alias("sequel_id"),
        ),
    )


def best_match(candidates: DataFrame, by: str, score: str, order: str, least: float) -> DataFrame:
    """The candidate of each search with the greatest score, the first by ``order`` of several; none where even that is below ``least``."""
    best = candidates.groupBy(by).agg(F.min_by(F.struct("*"), F.struct(-F.col(score), F.col(order))).alias("_b"))
    return best.select("_b.*").where(F.col(score) >= least)


def follow(requests: DataFrame, links: DataFrame, most: int = 63) -> DataFrame:
    """``requests`` (``id``, ``hops``) with ``reached``: where so many links (``id, next``) lead; null where the chain ends before, or beyond ``most`` hops.

    By halves: tables of 1, 2, 4 ... links are made from each other, and each
    request takes those that its number of hops is made of. So ``most`` hops
    take log2(most) joins by id, and circles do no harm.
    """
    at, jumps = requests.withColumn("reached", F.when(F.col("hops").between(0, most), F.col("id"))), links.where("next is not null").select("id", "next")
    for bit in range(max(1, most).bit_length()):
        step = jumps.select(F.col("id").alias("_from"), F.col("next").alias("_to"))
        taken = F.shiftright(F.col("hops").cast("long"), bit).bitwiseAND(F.lit(1)) == 1
        met = at.join(step, F.col("reached") == F.col("_from"), "left")
        at = written(met.withColumn("reached", F.when(taken, F.col("_to")).otherwise(F.col("reached"))).drop("_from", "_to"), "followed")
        if bit + 1 < max(1, most).bit_length():
            further = jumps.select(F.col("id").alias("next"), F.col("next").alias("_to"))
            jumps = written(jumps.join(further, "next").select("id", F.col("_to").alias("next")), "links")
    return at


def season_of(searches: DataFrame, candidates: DataFrame, links: DataFrame, least: float = 0.75) -> DataFrame:
    """``search``, ``number``, ``first`` and ``found``: the first season that matches each search well enough, and the season of that number, reached by sequels.

    ``searches``: ``search, number``; ``candidates``: ``search, id, score, place``.
    """
    first = best_match(candidates, "search", "score", "place", least).select("search", "id")
    asked = searches.join(first, "search").select("search", "number", "id", (F.col("number") - 1).alias("hops"))
    return follow(asked, links).select("search", "number", F.col("id").alias("first"), F.col("reached").alias("found"))


#: Kinds of spans that a player may skip.
SKIP_KINDS = ("op", "ed", "recap", "mixed-op", "mixed-ed")
SKIPS = "found boolean, results array<struct<skipType string, interval struct<startTime double, endTime double>, episodeLength double>>"
EPISODES = "data array<struct<mal_id int, title string, filler boolean, recap boolean>>"


def skip_times(payloads: DataFrame, key: str, payload: str, duration: str, most: float = 15.0) -> DataFrame:
    """``key, kind, start, end`` of the spans in each episode's payload that fit its ``duration``.

    Of each kind the entry counts whose file is nearest in length, the first of
    several; those that differ by more than ``most`` do not count, as their
    times belong to another cut. A null duration or length fits by 0. Payloads
    that are no JSON, say nothing was found, or name other kinds give no rows.
    """
    p = payloads.select(key, duration, F.from_json(F.col(payload), SKIPS).alias("p")).where("p.found")
    r = p.select(key, duration, F.posexplode("p.results").alias("_at", "r")).where(F.col("r.skipType").isin(*SKIP_KINDS))
    r = r.withColumn("_off", F.coalesce(F.abs(F.col("r.episodeLength") - F.col(duration)), F.lit(0.0))).where(F.col("_off") <= most)
    best = r.groupBy(key, F.col("r.skipType").alias("kind")).agg(F.min_by("r.interval", F.struct("_off", "_at")).alias("i"))
    return best.select(key, "kind", F.col("i.startTime").alias("start"), F.col("i.endTime").alias("end"))


def episode_list(pages: DataFrame, key: str, page: str, payload: str) -> DataFrame:
    """``key, number, title, filler, recap`` of the episodes in the pages of each series; the last page that has a number counts, its last entry first."""
    e = pages.select(key, page, F.posexplode(F.from_json(F.col(payload), EPISODES)["data"]).alias("_at", "e")).where("e.mal_id is not null")
    last = e.groupBy(key, F.col("e.mal_id").alias("number")).agg(F.max_by("e", F.struct(page, "_at")).alias("e"))
    return last.select(key, "number", "e.title", F.coalesce("e.filler", F.lit(False)).alias("filler"), F.coalesce("e.recap", F.lit(False)).alias("recap"))
