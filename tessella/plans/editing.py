"""Queries over libraries of songs and finished edits: parts are tracks, orders are edits of line items, events are samples, beats and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import boxes, edits, fusion, library, ranks, series, stages, vectors
from tessella.operators import clips as cut
from tessella.plans.indexing import DAY, faces_of
from tessella.plans.queries import CLIPS, HOUR, HOURLY, KEY, KEYS, MOODS, POOL, PROMPTS, SPANS, TARGET, clips, fitted, hourly, pool_of, prompt_sims, query, spans, top_pool
from tessella.sources.readers import table

# Clips -----------------------------------------------------------------------------------------------------------------------------
RATE, BLOCK, FULL = 4, 64, 10_000


@query(
    "clip_loudness",
    f"""WITH {SPANS}, x AS (SELECT axis, seg, CAST(floor(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY axis ORDER BY s, seg) - 1 AS i, count(*) OVER (PARTITION BY axis) AS n FROM spans),
c AS (SELECT axis, i, sum(v * v) OVER (PARTITION BY axis ORDER BY i) AS upto, v * v AS own FROM x),
k AS (SELECT axis, seg, i AS a, least(i + v % 37, n) AS b FROM x)
SELECT k.axis, k.seg, CASE WHEN b > a THEN round(greatest(-100.0, 20 * log10(sqrt(CAST(z.upto - c.upto + c.own AS DOUBLE) / (b - a)) / {FULL} + 1e-10)), 2) ELSE -100.0 END AS loudness
FROM k JOIN c ON c.axis = k.axis AND c.i = a LEFT JOIN c z ON z.axis = k.axis AND z.i = b - 1""",
)
def clip_loudness(spark, sf):
    """Every event a sample of its user's audio, four a second, and the start of a clip of up to nine seconds."""
    order = Window.partitionBy("axis").orderBy("s", "seg")
    x = spans(spark, sf).select("axis", "seg", F.floor(F.col("value") * 100).alias("v"), (F.row_number().over(order) - 1).alias("i"))
    blocks = x.groupBy("axis", F.expr(f"i div {BLOCK}").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("samples"))
    start = (F.col("i") + 0.3) / RATE
    return cut.clip_audio(x.select("axis", "seg", start.alias("start"), (start + F.col("v") % 37 / RATE).alias("end")), blocks, "axis", "seg", RATE, BLOCK, FULL)


@query(
    "usable_scenes",
    f"""WITH {SPANS}, o AS (SELECT axis, seg, s - min(s) OVER w AS a, e - min(s) OVER w AS b, max(e) OVER w - min(s) OVER w AS duration FROM spans WINDOW w AS (PARTITION BY axis))
SELECT * FROM (SELECT axis, seg, greatest(a, {3 * DAY}) AS start, least(b, duration - {2 * DAY}) AS "end" FROM o) WHERE "end" > start""",
)
def usable_scenes(spark, sf):
    w = Window.partitionBy("axis")
    first = F.min("s").over(w)
    scenes = spans(spark, sf).select("axis", "seg", (F.col("s") - first).alias("start"), (F.col("e") - first).alias("end"), (F.max("e").over(w) - first).alias("duration"))
    return cut.usable(scenes, F.lit(3 * DAY), F.lit(2 * DAY)).drop("duration")


@query(
    "largest_faces",
    f"""WITH {SPANS}, d AS (SELECT axis, seg, CAST(floor(value * 100) AS BIGINT) AS v, (s - min(s) OVER (PARTITION BY axis)) // {DAY} AS day FROM spans),
f AS (SELECT axis, day::DOUBLE AS time, seg, (axis * 37 % 500 + v % 300) / 1000.0::DOUBLE AS x0, (axis * 37 % 500 + v % 300) / 1000.0::DOUBLE + (40 + seg % 90) / 1000.0::DOUBLE AS x1, 0.25::DOUBLE + (1 + v % 7) / 16.0::DOUBLE AS y1 FROM d)
SELECT axis, time, seg AS face_id FROM (SELECT *, row_number() OVER (PARTITION BY axis, time ORDER BY (x1 - x0) * (y1 - 0.25::DOUBLE) DESC, seg) AS pos FROM f WHERE y1 - 0.25::DOUBLE >= 0.125 AND x1 > x0) WHERE pos <= 2""",
)
def largest_faces(spark, sf):
    return boxes.keep_largest(faces_of(spark, sf), ["axis", "time"], 0.125, 2, "face_id").select("axis", "time", "face_id")


@query(
    "quality_prompts",
    f"""WITH {CLIPS}, m AS (SELECT season, median(loudness) AS typical FROM clips GROUP BY season), q AS (SELECT *, coalesce(speech * 5.0::DOUBLE, 0.0) AS p, tax * 6.0::DOUBLE AS b FROM clips JOIN m USING (season))
SELECT {KEYS}, CASE WHEN length / 50 < 0.03 THEN 'flat' WHEN greatest(p, b) >= 0.45 THEN CASE WHEN p >= b THEN 'writing' ELSE 'unsharp' END WHEN loudness < typical * 0.2 THEN 'blurry' END AS issue,
  CASE WHEN length / 50 < 0.03 OR greatest(p, b) >= 0.45 THEN 0.0 WHEN loudness < typical * 0.2 THEN 0.2 ELSE round(greatest(0.5::DOUBLE, 1.0::DOUBLE - 0.5::DOUBLE * least(1.0::DOUBLE, (p + b) / 0.45::DOUBLE)), 3) END::DOUBLE AS score FROM q""",
)
def quality_prompts(spark, sf):
    c = clips(spark, sf)
    m = ranks.medians(c, ["season"], "loudness", "typical")
    faults = {"writing": F.col("speech") * 5.0, "unsharp": F.col("tax") * 6.0}
    q = fusion.quality(F.lit(0.5), F.lit(0.5), F.col("length") / 50, F.col("loudness"), F.col("typical"), faults, 0.45)
    return c.join(m, "season").withColumn("q", q).select(*KEY, F.col("q.issue").alias("issue"), F.col("q.score").alias("score"))


# Songs -----------------------------------------------------------------------------------------------------------------------------
@query(
    "downbeat_signals",
    f"""WITH {SPANS}, {HOURLY}, c AS (SELECT *, abs(energy - coalesce(lag(energy) OVER (PARTITION BY axis ORDER BY i), energy)) AS change FROM hourly),
z AS (SELECT axis, i, {' + '.join(f"CASE WHEN stddev_pop({v}) OVER w > 1e-9 THEN ({v} - avg({v}) OVER w) / stddev_pop({v}) OVER w ELSE 0.0 END" for v in ("energy", "change"))} AS z FROM c WINDOW w AS (PARTITION BY axis)),
m AS (SELECT axis, CAST(i % 4 AS INT) AS phase, round(avg(z), 6) AS mean FROM z GROUP BY ALL) SELECT axis, phase, mean + 0.0 AS mean FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY mean DESC, phase) AS pos FROM m) WHERE pos = 1""",
)
def downbeat_signals(spark, sf):
    """Beats by energy and by its change from the beat before."""
    before = F.lag("energy").over(Window.partitionBy("axis").orderBy("i"))
    h = hourly(spark, sf).withColumn("change", F.abs(F.col("energy") - F.coalesce(before, F.col("energy"))))
    return series.downbeat_phase(h, ["axis"], "i", ["energy", "change"]).withColumn("mean", F.col("mean") + 0.0)


@query(
    "song_windows_moods",
    f"""WITH {PROMPTS}, heard AS (SELECT vec_id // 6 AS song, grp, prompt, avg(p) AS p FROM soft GROUP BY ALL), g AS (SELECT song, grp, avg(p) AS p FROM heard GROUP BY ALL),
t AS (SELECT song, arg_max(prompt, (p, -prompt)) AS top FROM heard GROUP BY song)
SELECT song, grp, round(p / sum(p) OVER w, 4) AS p, round(least(1.0, p / sum(p) OVER w * count(*) OVER w / 2), 3) AS mood, top FROM g JOIN t USING (song) WINDOW w AS (PARTITION BY song)""",
)
def song_windows_moods(spark, sf):
    """Six vectors in a row are the windows of one song."""
    sims = prompt_sims(spark, sf).withColumn("song", F.expr("vec_id div 6"))
    return vectors.zero_shot_windows(sims, "song", "vec_id", "grp", "prompt", 10.0)


@query(
    "song_starts",
    f"""WITH {SPANS}, b AS (SELECT axis, s - min(s) OVER (PARTITION BY axis) AS t, max(s) OVER (PARTITION BY axis) - min(s) OVER (PARTITION BY axis) AS duration FROM spans),
r AS (SELECT axis, request, duration, CASE request WHEN 1 THEN duration // 2 WHEN 2 THEN duration - {3 * HOUR} END AS wanted, CASE WHEN axis % 17 = 0 THEN duration + 1 ELSE (axis % 5 + 1) * {6 * HOUR} END AS length FROM (SELECT axis, max(duration) AS duration, unnest([0, 1, 2]) AS request FROM b GROUP BY axis)),
g AS (SELECT r.axis, request, r.duration, length, min(t) AS early, arg_min(t, (abs(t - wanted), t)) FILTER (wanted IS NOT NULL) AS near, max(t) FILTER (t + length <= r.duration) AS fits FROM r LEFT JOIN b ON b.axis = r.axis AND r.axis % 19 <> 0 GROUP BY ALL)
SELECT axis, CAST(request AS INT) AS request, CASE WHEN early IS NULL THEN 'no beats' WHEN length > duration THEN 'too short' ELSE 'ok' END AS status,
  CASE WHEN early IS NULL OR length > duration THEN NULL WHEN coalesce(near, early) + length > duration THEN coalesce(fits, 0) ELSE coalesce(near, early) END AS start FROM g""",
)
def song_starts(spark, sf):
    """Every user a song whose beats are the events; some have none, and some are shorter than what is asked."""
    w = Window.partitionBy("axis")
    b = spans(spark, sf).select("axis", (F.col("s") - F.min("s").over(w)).alias("t"))
    r = b.groupBy("axis").agg(F.max("t").alias("duration")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("request"))
    wanted = F.when(F.col("request") == 1, F.expr("duration div 2")).when(F.col("request") == 2, F.col("duration") - 3 * HOUR)
    length = F.when(F.col("axis") % 17 == 0, F.col("duration") + 1).otherwise((F.col("axis") % 5 + 1) * 6 * HOUR)
    return edits.song_starts(r.select("axis", "request", "duration", wanted.alias("wanted"), length.alias("length")), b.where("axis % 19 <> 0"), "axis", "request")


# Libraries -------------------------------------------------------------------------------------------------------------------------
# Every part is a track of its brand's library; four of five were known before, some of them under another title, size or source.
TRACK = """track AS (SELECT p_brand AS library, p_partkey AS id, '/music/' || p_brand || '/' || p_name || '.' || p_partkey || '.mp3' AS path, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS artist, CAST(NULL AS VARCHAR) AS album,
  CASE WHEN p_partkey % 4 = 0 THEN [p_type] END AS genres, CASE WHEN p_partkey % 4 = 0 THEN p_size * 20.0::DOUBLE END AS duration, p_size AS size, p_partkey % 9 AS mtime, p_partkey % 4 = 0 AS tagged, CASE WHEN p_partkey % 8 = 0 THEN 'i' || p_partkey END AS source_id, p_name, p_type FROM part),
known AS (SELECT path, CASE WHEN id % 6 <> 1 THEN upper(p_name) END AS title, p_type AS artist, 'album' AS album, [lower(p_type), 'pop'] AS genres, size * 25.0::DOUBLE AS duration, size, CASE WHEN id % 7 = 0 THEN mtime + 1 ELSE mtime END AS mtime,
  CASE WHEN id % 16 = 0 THEN 'other' ELSE source_id END AS source_id, CASE WHEN id % 11 <> 0 THEN 'a' END AS analysis, CASE WHEN id % 13 <> 0 THEN 'm' END AS mood, id FROM track WHERE id % 5 <> 0),
filled AS (SELECT t.library, t.id, t.path, t.source_id, t.size, t.mtime, CASE WHEN take THEN k.title ELSE t.title END AS title, CASE WHEN take THEN k.artist ELSE t.artist END AS artist, CASE WHEN take THEN k.album ELSE t.album END AS album, CASE WHEN take THEN k.genres ELSE t.genres END AS genres,
  CASE WHEN take THEN k.duration ELSE t.duration END AS duration, take OR t.tagged AS tagged FROM (SELECT t.*, coalesce(NOT t.tagged AND k.title IS NOT NULL AND k.size = t.size AND k.mtime = t.mtime, false) AS take FROM track t LEFT JOIN known k USING (path)) t LEFT JOIN known k USING (path))"""
LIMIT = 20


def tracks_of(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    read = lambda c: F.when(k % 4 == 0, c)
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("library"), k.alias("id"), F.concat(F.lit("/music/"), "p_brand", F.lit("/"), name, F.lit("."), k, F.lit(".mp3")).alias("path"), read(name).alias("title"), read(F.col("p_type")).alias("artist"), F.lit(None).cast("string").alias("album"),
        read(F.array("p_type")).alias("genres"), read(F.col("p_size") * 20.0).alias("duration"), F.col("p_size").alias("size"), (k % 9).alias("mtime"), (k % 4 == 0).alias("tagged"), F.when(k % 8 == 0, F.concat(F.lit("i"), k)).alias("source_id"), "p_name", "p_type",
    )


def known_of(tracks):
    i = F.col("id")
    return tracks.where("id % 5 <> 0").select(
        "path", F.when(i % 6 != 1, F.upper("p_name")).alias("title"), F.col("p_type").alias("artist"), F.lit("album").alias("album"), F.array(F.lower("p_type"), F.lit("pop")).alias("genres"), (F.col("size") * 25.0).alias("duration"), "size", F.when(i % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"),
        F.when(i % 16 == 0, "other").otherwise(F.col("source_id")).alias("source_id"), F.when(i % 11 != 0, "a").alias("analysis"), F.when(i % 13 != 0, "m").alias("mood"), "id",
    )


def filled_of(spark, sf):
    t = tracks_of(spark, sf)
    known = known_of(t)
    return library.fill_tags(t.drop("p_name", "p_type"), known), known


@query("library_tags", f"WITH {TRACK} SELECT library, id, title, artist, album, array_to_string(genres, ',') AS genres, duration, tagged FROM filled")
def library_tags(spark, sf):
    return filled_of(spark, sf)[0].select("library", "id", "title", "artist", "album", F.array_join("genres", ",").alias("genres"), "duration", "tagged")


PLANNED = f"""{TRACK}, s AS (SELECT f.*, CASE WHEN f.id % 10 = 3 AND f.id % 20 <> 13 THEN 'failed_before' WHEN NOT (contains(lower(concat_ws(' ', nullif(artist, ''), nullif(title, ''), nullif(album, ''), split_part(f.path, '/', -1))), 'r') AND coalesce(len(list_filter(genres, lambda g: contains(lower(g), 'o'))) > 0, false)) THEN 'filtered'
  WHEN duration < 100 OR duration > 1000 THEN 'wrong_length' WHEN k.path IS NOT NULL THEN 'known' ELSE 'todo' END AS status, k.path IS NOT NULL AND (f.title IS DISTINCT FROM k.ktitle OR f.source_id IS DISTINCT FROM k.ksource) AS other
  FROM filled f LEFT JOIN (SELECT path, size, mtime, title AS ktitle, source_id AS ksource FROM known WHERE analysis IS NOT NULL AND mood IS NOT NULL) k ON k.path = f.path AND k.size = f.size AND k.mtime = f.mtime),
planned AS (SELECT library, id, CASE WHEN status = 'todo' AND row_number() OVER (PARTITION BY library, status ORDER BY path) > {LIMIT} THEN 'pending' ELSE status END AS status, status = 'known' AND other AS retag FROM s)"""


def planned_of(spark, sf):
    """A run that looks for an r in the names and an o in the genres; a tenth of the files failed before, half of them as other files."""
    tracks, known = filled_of(spark, sf)
    failed = tracks.where("id % 10 = 3").select("path", "size", F.when(F.col("id") % 20 == 13, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return library.plan_run(tracks, known, failed, "library", library.matches("R", "o"), LIMIT, 100.0, 1000.0)


@query("library_plan", f"WITH {PLANNED} SELECT library, id, status, retag FROM planned")
def library_plan(spark, sf):
    return planned_of(spark, sf).select("library", "id", "status", "retag")


@query("library_report", f"WITH {PLANNED} SELECT library, count(*) AS found, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in library.STATES)}, count(*) FILTER (retag) AS retag FROM planned GROUP BY library")
def library_report(spark, sf):
    return library.report(planned_of(spark, sf), "library")


@query(
    "library_merge",
    f"WITH {TRACK} SELECT coalesce(t.path, k.path) AS path, CASE WHEN t.path IS NOT NULL THEN t.title ELSE k.title END AS title, CASE WHEN t.path IS NOT NULL THEN t.size ELSE k.size END AS size, k.analysis FROM known k FULL JOIN (SELECT * FROM track WHERE id % 3 = 0) t ON t.path = k.path",
)
def library_merge(spark, sf):
    """A run wrote titles and sizes of every third track."""
    t = tracks_of(spark, sf)
    known = known_of(t).select("path", "title", "size", "analysis")
    return library.merge_songs(known, t.where("id % 3 = 0").select("path", "title", "size"))


SONGS = """song AS (SELECT p_brand AS library, p_partkey AS id, '/music/' || p_name || p_partkey AS path, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'folder' END AS source, CASE WHEN p_partkey % 7 > 0 THEN 'm' END AS mood, CASE WHEN p_partkey % 9 > 0 THEN 'a' END AS analysis,
  p_size AS size, CASE WHEN p_partkey % 8 > 0 THEN p_size || '-' || p_partkey % 4 END AS content, p_partkey % 5 < 2 AS heard FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY library, size, content ORDER BY source IS NULL, title IS NULL, length(path), path) AS pos FROM song WHERE mood IS NOT NULL AND analysis IS NOT NULL AND content IS NOT NULL)"""


def songs_of(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("library"), k.alias("id"), F.concat(F.lit("/music/"), "p_name", k).alias("path"), F.when(k % 3 > 0, F.col("p_name")).alias("title"), F.when(k % 2 == 0, "folder").alias("source"), F.when(k % 7 > 0, "m").alias("mood"), F.when(k % 9 > 0, "a").alias("analysis"),
        F.col("p_size").alias("size"), F.when(k % 8 > 0, F.concat("p_size", F.lit("-"), k % 4)).alias("content"), F.when(k % 5 < 2, F.array(F.lit("measures"), F.lit("model"))).otherwise(F.array(F.lit("measures"))).alias("signals"),
    )
    return library.usable_songs(rows, "library")


@query("library_songs", f"WITH {SONGS} SELECT library, id FROM ranked WHERE pos = 1")
def library_songs(spark, sf):
    return songs_of(spark, sf)[0].select("library", "id")


@query(
    "library_counts",
    f"""WITH {SONGS} SELECT s.library, count(*) FILTER (mood IS NULL OR analysis IS NULL) AS no_mood, count(*) FILTER (mood IS NOT NULL AND analysis IS NOT NULL AND content IS NULL) AS missing, any_value(songs) AS songs, any_value(copies) AS copies, any_value(measured_only) AS measured_only
FROM song s JOIN (SELECT library, count(*) FILTER (pos = 1) AS songs, count(*) FILTER (pos > 1) AS copies, count(*) FILTER (pos = 1 AND NOT heard) AS measured_only FROM ranked GROUP BY library) r ON r.library = s.library GROUP BY s.library""",
)
def library_counts(spark, sf):
    return songs_of(spark, sf)[1]


# Edits -----------------------------------------------------------------------------------------------------------------------------
WEIGHTS = {"mood": 1.0, "energy": 0.8, "character": 1.0, "repeat": 0.3, "overuse": 0.3}
CHOSEN = """chosen AS (SELECT o_custkey AS edit, o_orderkey AS slot, nullif(o_orderkey % 5, 4) AS episode, o_custkey % 10 / 10::DOUBLE AS energy, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 / 8::DOUBLE END AS mood, (CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0 END + CASE WHEN o_orderkey % 6 = 2 THEN 0.75::DOUBLE ELSE 0.0 END) / 2 AS character FROM orders),
used AS (SELECT *, row_number() OVER (PARTITION BY edit ORDER BY slot) - 1 AS total, row_number() OVER (PARTITION BY edit, episode ORDER BY slot) - 1 AS own,
  coalesce(sum(1) OVER l, 0) AS several, list(episode) OVER l AS earlier FROM chosen WINDOW l AS (PARTITION BY edit ORDER BY slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
parts AS (SELECT *, round(CASE WHEN episode IS NULL OR several = 0 THEN 0.0 ELSE coalesce(len(list_filter(earlier, lambda e: e = episode)), 0) / several END, 3) AS repeat,
  round(CASE WHEN episode IS NULL OR total = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, own - total / 5) / (total / 5 + 1.0::DOUBLE)) END, 3) AS overuse FROM used)"""


def chosen_of(spark, sf):
    k = F.col("o_orderkey")
    found = F.map_from_entries(F.filter(F.array(F.when(k % 2 == 0, F.struct(F.lit(3).cast("long"), F.lit(0.5))), F.when(k % 6 == 2, F.struct(F.lit(8).cast("long"), F.lit(0.75)))), lambda x: x.isNotNull()))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("edit"), k.alias("slot"), F.nullif(k % 5, F.lit(4)).alias("episode"), F.lit(5).alias("episodes"), (F.col("o_custkey") % 10 / 10).alias("energy"), F.when(k % 3 > 0, k % 7 / 8).alias("mood"), edits.character_match(found, (3, 8)).alias("character")
    )


@query("edit_choices", f"WITH {CHOSEN} SELECT edit, slot, episode, repeat, overuse, round(coalesce(mood, 0.5) * 1.0 + energy * 0.8::DOUBLE + character * 1.0 - repeat * 0.3::DOUBLE - overuse * 0.3::DOUBLE, 4) AS score FROM parts")
def edit_choices(spark, sf):
    """The orders of a customer as the choices of an edit, of which every fifth has no episode."""
    return edits.scored(edits.choices(chosen_of(spark, sf), "edit", "slot", 3), WEIGHTS).select("edit", "slot", "episode", "repeat", "overuse", "score")


@query(
    "edit_moods",
    f"""WITH {POOL}, r AS (SELECT season, avg(action) AS action, avg(calm) AS calm, count(*) FILTER (action >= calm) AS first, count(*) FILTER (calm > action) AS second FROM pool GROUP BY season)
SELECT season, 'action' AS mood, round(action, 4) AS average, first AS strongest FROM r UNION ALL SELECT season, 'calm', round(calm, 4), second FROM r""",
)
def edit_moods(spark, sf):
    """The pool of a season as an edit."""
    return edits.edit_moods(top_pool(spark, sf), ["season"], ["action", "calm"])


FIT = "avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0 * action + -0.5 * calm + 0.5) / 1.5)))"


@query("edit_style_fit", f"WITH {POOL} SELECT p.season, in_edit, in_season FROM (SELECT season, round({FIT}, 4) AS in_edit FROM pool GROUP BY season) p JOIN (SELECT season, round({FIT}, 4) AS in_season FROM moods GROUP BY season) m ON m.season = p.season")
def edit_style_fit(spark, sf):
    fits = fitted(spark, sf)
    return edits.style_fit(pool_of(fits), fits, ["season"], "season", TARGET)


@query(
    "edit_plans",
    """WITH c AS (SELECT l_orderkey, list({'slot': l_linenumber, 'video': l_partkey, 'episode': nullif(l_suppkey % 13, 0), 'transition': l_returnflag, 'speech': l_discount} ORDER BY l_linenumber, l_partkey, nullif(l_suppkey % 13, 0) NULLS FIRST, l_returnflag, l_discount) AS clips FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(to_json({'o_orderkey': o_orderkey, 'style': nullif(o_orderstatus, 'P'), 'seed': o_custkey, 'clips': coalesce(clips, [])}) AS VARCHAR) AS plan FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def edit_plans(spark, sf):
    made = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("style"), F.col("o_custkey").alias("seed"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("video"), F.nullif(F.col("l_suppkey") % 13, F.lit(0)).alias("episode"), F.col("l_returnflag").alias("transition"), F.col("l_discount").alias("speech"))
    return edits.plans(made, li, "o_orderkey", "slot")


# Names and files -------------------------------------------------------------------------------------------------------------------
# Names are made of keys, so the SQL knows what they mean without reading them.
N, S = "(p_partkey % 97 + 1)", "(p_partkey % 9 + 1)"
FORMS = [
    (f"concat('[Grp] ', p_name, ' - ', lpad(cast({N} as string), 2, '0'), ' (1080p) [ABCD1234].mkv')", "NULL", "p_name"),
    (f"concat(replace(p_name, ' ', '.'), '.S0', {S}, 'E', lpad(cast({N} as string), 2, '0'), '.1080p.WEB.x264.mkv')", S, "p_name"),
    (f"concat(p_name, ' Episode ', {N}, '.mp4')", "NULL", f"concat(p_name, ' Episode ', {N})"),
    (f"concat(replace(p_name, ' ', '_'), '_Folge_', {N}, '.mkv')", "NULL", f"concat(p_name, ' Folge ', {N})"),
    (f"concat(p_name, ' - 0', {S}, 'x', lpad(cast({N} as string), 2, '0'), ' - Part 2.mp4')", S, "p_name"),
    (f"concat(lpad(cast({N} as string), 2, '0'), '.mkv')", "NULL", f"lpad(cast({N} as string), 2, '0')"),
]


def _form(k: int) -> str:
    return " ".join(["CASE", *[f"WHEN p_partkey % {len(FORMS)} = {i} THEN {form[k]}" for i, form in enumerate(FORMS)], "END"])


@query("file_names", f"SELECT p_partkey, CAST({N} AS INT) AS episode, CAST({_form(1)} AS INT) AS season, {_form(2).replace('as string', 'as varchar')} AS title FROM part")
def file_names(spark, sf):
    """Every part a file in a folder that says only which season it is."""
    p = table(spark, sf, "part").select("p_partkey", F.expr(_form(0)).alias("name"))
    name = F.col("name")
    return p.select("p_partkey", names.episode_number(name).alias("episode"), names.season_number(name).alias("season"), names.guess_title(F.lit("Season 2"), F.lit("S1"), name).alias("title"))


LABELS = [
    ("p_brand", "concat(p_brand, ' - ', p_name, ' (Official Video)')", "concat(p_brand, ' - ', p_name)"), ("'Some Records'", "concat('DJ ', p_type, ' – ', p_name, ' | NCS | Lyrics')", "concat('DJ ', p_type, ' - ', p_name)"), ("p_brand", "concat(p_name, ' [HD] (Lyric Video)')", "concat(p_brand, ' - ', p_name)"),
    ("CAST(NULL AS STRING)", "concat(p_name, ' Official Music Video mv')", "p_name"), ("split_part(p_name, ' ', 1)", "p_name", "p_name"), ("p_brand", "concat('\"', p_name, '\"')", "concat(p_brand, ' - ', p_name)"), ("concat(p_brand, '0')", "concat(p_brand, ' - ', p_name)", "concat(p_brand, '0 - ', p_brand, ' - ', p_name)"),
]


def _label(k: int) -> str:
    return " ".join(["CASE", *[f"WHEN p_partkey % {len(LABELS)} = {i} THEN {form[k]}" for i, form in enumerate(LABELS)], "END"])


@query("song_labels", f"SELECT p_partkey, {_label(2)} AS label FROM part")
def song_labels(spark, sf):
    """Every part a song whose tags name artists, channels or nobody."""
    p = table(spark, sf, "part").select("p_partkey", F.expr(_label(0)).alias("artist"), F.expr(_label(1)).alias("title"))
    return p.select("p_partkey", names.song_label(F.col("artist"), F.col("title")).alias("label"))


EPISODE = """e AS (SELECT doc_id // 20 AS season, doc_id % 20 AS number, * FROM documents),
o AS (SELECT season, number, CASE WHEN doc_id % 4 > 0 THEN 'old ' || doc_id END AS title, false AS filler, 'f' || doc_id AS path, CASE WHEN doc_id % 6 > 0 THEN CAST(n_chars AS BIGINT) END AS size, CAST(doc_id % 3 AS BIGINT) AS mtime, CASE WHEN doc_id % 7 > 0 THEN 'sk' END AS skips, CASE WHEN doc_id % 11 > 0 THEN 'sc' END AS scenes FROM e WHERE doc_id % 5 > 0),
f AS (SELECT season, number, CASE WHEN doc_id % 3 = 0 THEN 'file ' || doc_id END AS title, CASE WHEN doc_id % 8 > 1 THEN 'g' || doc_id END AS path, CAST(n_chars AS BIGINT) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS size, CAST(doc_id % 3 AS BIGINT) AS mtime FROM e WHERE doc_id % 13 > 0),
m AS (SELECT season, number, CASE WHEN doc_id % 2 = 0 THEN 'meta ' || doc_id END AS title, doc_id % 10 = 7 AS filler FROM e WHERE doc_id % 4 <> 1),
x AS (SELECT coalesce(o.season, f.season) AS season, coalesce(o.number, f.number) AS number, o.season IS NOT NULL AS had, f.season IS NOT NULL AS seen, o.title AS otitle, f.title AS ftitle, o.filler, o.path AS opath, f.path AS fpath, o.size AS osize, f.size AS fsize, skips, scenes,
  CASE WHEN f.season IS NULL THEN NULL WHEN f.path IS NOT NULL THEN 'ready' WHEN skips IS NOT NULL AND scenes IS NOT NULL THEN 'known' ELSE 'missing' END AS work, f.path IS NOT NULL AND o.size IS NOT NULL AND o.size <> f.size AS other FROM o FULL JOIN f ON f.season = o.season AND f.number = o.number)"""


@query(
    "episodes_prepared",
    f"""WITH {EPISODE} SELECT x.season, x.number, CASE WHEN seen THEN coalesce(ftitle, m.title, otitle) ELSE otitle END AS title, CASE WHEN seen AND m.season IS NOT NULL THEN m.filler ELSE x.filler END AS filler, CASE WHEN work = 'ready' THEN fpath ELSE opath END AS path,
  CASE WHEN work = 'ready' THEN fsize ELSE osize END AS size, CASE WHEN NOT other THEN skips END AS skips, CASE WHEN NOT other THEN scenes END AS scenes, work, coalesce(work = 'ready' AND (other OR skips IS NULL), false) AS open FROM x LEFT JOIN m ON m.season = x.season AND m.number = x.number WHERE had OR work = 'ready'""",
)
def episodes_prepared(spark, sf):
    """Every document an episode: a fifth are new, some have no file here, and some files are others than before."""
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    e = table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 20").alias("season"), (d % 20).alias("number"), F.col("n_chars").cast("long").alias("size"), (d % 3).cast("long").alias("mtime"))
    named = lambda condition, word: F.when(condition, F.concat(F.lit(word), d))
    stored = e.where("doc_id % 5 > 0").select(
        "season", "number", named(d % 4 > 0, "old ").alias("title"), F.lit(False).alias("filler"), F.lit(False).alias("recap"), none.alias("source_id"), F.concat(F.lit("f"), d).alias("path"), F.when(d % 6 > 0, F.col("size")).alias("size"), "mtime",
        F.when(d % 7 > 0, "sk").alias("skips"), F.when(d % 11 > 0, "sc").alias("scenes"),
    )
    found = e.where("doc_id % 13 > 0").select("season", "number", named(d % 3 == 0, "file ").alias("title"), none.alias("source_id"), named(d % 8 > 1, "g").alias("path"), (F.col("size") + F.when(d % 9 == 0, 1).otherwise(0)).alias("size"), "mtime")
    meta = e.where("doc_id % 4 <> 1").select("season", "number", named(d % 2 == 0, "meta ").alias("title"), (d % 10 == 7).alias("filler"), F.lit(False).alias("recap"))
    after = stages.prepare_episodes(stored, found, meta, "season", "number", ("skips", "scenes"), ("skips", "scenes"))
    return after.select("season", "number", "title", "filler", "path", "size", "skips", "scenes", "work", "open")
