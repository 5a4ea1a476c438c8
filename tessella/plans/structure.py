"""Queries over the structure of songs and episodes: every user of ``events`` is a song whose beats are the events, times in microseconds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import boxes, clips, matching, media, song
from tessella.operators import effects as fx
from tessella.operators import suggest as songs_for
from tessella.operators.fusion import MOODS
from tessella.plans.queries import HOUR, POOL, SLOTS, SPANS, query, spans, top_pool
from tessella.plans.queries import slots_of as uniform
from tessella.session import written
from tessella.sources.readers import table

STEP, LENGTH, MIN_SLOT = 6 * HOUR, 12 * 24 * HOUR, HOUR
RULES = song.CutRules(shortest=2 * HOUR)
LABELS = ("intro", "verse", "chorus", "bridge", "outro")


def beats_of(spark, sf):
    """Songs of eight beats or more: their beats from 0 on."""
    t = (F.col("s") - F.min("s").over(Window.partitionBy("axis"))).alias("t")
    b = spans(spark, sf).select("axis", "s").distinct().select("axis", t)
    w = Window.partitionBy("axis")
    return b.withColumns({"i": F.row_number().over(w.orderBy("t")).cast("long") - 1, "n": F.count("*").over(w)}).where("n >= 8").drop("n")


def songs_of(beats):
    g = beats.groupBy("axis").agg(F.max("t").alias("last"), F.count("*").alias("n"))
    return g.select("axis", F.expr("last div (n - 1)").alias("beat"), (F.col("last") + F.expr("last div (n - 1)")).alias("duration"))


def sections_of(songs):
    day = 24 * HOUR
    k = songs.select("axis", "duration", F.explode(F.sequence(F.lit(0), F.expr(f"duration div {5 * day}"))).alias("k"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("axis") + F.col("k")) % 5 + 1).cast("int"))
    return k.select("axis", (F.col("k") * 5 * day).alias("start"), ((F.col("k") + 1) * 5 * day).alias("end"), label.alias("label"))


def timed(spark, sf, songs, where):
    """Events of some kind, from the beginning of their song on."""
    s = spans(spark, sf)
    first = s.groupBy("axis").agg(F.min("s").alias("zero"))
    return s.where(where).join(first, "axis").join(songs.select("axis"), "axis", "left_semi").select("axis", (F.col("s") - F.col("zero")).alias("time"), F.col("value").alias("strength"), "seg", (F.col("e") - F.col("s")).alias("size"))


def curve_of(spark, sf, songs):
    """Energy in steps of six hours: hundredths of the values, 0 where nothing happens."""
    dense = songs.select("axis", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"duration div {STEP}"))).alias("i"))
    e = timed(spark, sf, songs, "true").groupBy("axis", F.expr(f"time div {STEP}").alias("i")).agg(F.sum(F.floor(F.col("strength") * 100)).alias("value"))
    return dense.join(e, ["axis", "i"], "left").select("axis", "i", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


SONG = f"""{SPANS}, raw AS (SELECT axis, s - min(s) OVER (PARTITION BY axis) AS t FROM (SELECT DISTINCT axis, s FROM spans)),
beats AS (SELECT * FROM (SELECT axis, t, row_number() OVER (PARTITION BY axis ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY axis) AS n FROM raw) WHERE n >= 8),
songs AS (SELECT axis, max(t) // (count(*) - 1) AS beat, max(t) + max(t) // (count(*) - 1) AS duration FROM beats GROUP BY axis),
sections AS (SELECT axis, k * {120 * HOUR} AS start, (k + 1) * {120 * HOUR} AS "end", {list(LABELS)}[(axis + k) % 5 + 1] AS label FROM (SELECT axis, unnest(range(0, duration // {120 * HOUR} + 1)) AS k FROM songs)),
timed AS (SELECT axis, s - min(s) OVER (PARTITION BY axis) AS time, value AS strength, seg, e - s AS size, event_type FROM spans WHERE axis IN (SELECT axis FROM songs)),
drops AS (SELECT axis, time, strength FROM timed WHERE event_type = 'purchase' AND strength >= 100),
curve AS (SELECT x.axis, x.i, coalesce(v, 0) AS value FROM (SELECT axis, unnest(range(0, duration // {STEP} + 1)) AS i FROM songs) x
  LEFT JOIN (SELECT axis, time // {STEP} AS i, CAST(sum(CAST(floor(strength * 100) AS BIGINT)) AS BIGINT) AS v FROM timed GROUP BY ALL) y ON x.axis = y.axis AND x.i = y.i)"""


def parts_of(spark, sf):
    beats = written(beats_of(spark, sf), "beats")
    songs = written(songs_of(beats), "songs")
    return beats, songs, sections_of(songs), timed(spark, sf, songs, "event_type = 'purchase' and value >= 100"), song.prefix_sums(curve_of(spark, sf, songs), "axis")


def _mean(a: str, b: str, src: str) -> str:
    return f"""(SELECT r.*, coalesce((SELECT sum(value) / count(*) FROM curve c WHERE c.axis = r.axis AND c.i >= least({a} // {STEP}, m.n - 1)
  AND c.i < greatest(least({a} // {STEP}, m.n - 1) + 1, least(({b} + {STEP - 1}) // {STEP}, m.n))), 0.0) AS mean FROM {src} r JOIN (SELECT axis, count(*) AS n FROM curve GROUP BY axis) m USING (axis))"""


@query("mean_energy", f"WITH {SONG} SELECT axis, seg, round(mean, 4) AS energy FROM {_mean('r.time', '(r.time + r.size)', 'timed')}")
def mean_energy(spark, sf):
    _, songs, _, _, sums = parts_of(spark, sf)
    rows = timed(spark, sf, songs, "true").withColumn("until", F.col("time") + F.col("size"))
    return song.mean_between(rows, sums, "axis", "time", "until", STEP).select("axis", "seg", F.round("mean", 4).alias("energy"))


@query("song_sections", f"WITH {SONG}, cut AS (SELECT s.axis, greatest(0, start) AS start, least(\"end\", duration) AS \"end\", label FROM sections s JOIN songs USING (axis)) SELECT axis, start, \"end\", label, round(mean, 3) AS energy FROM {_mean('r.start', 'r.\"end\"', '(SELECT * FROM cut WHERE \"end\" > start)')}")
def song_sections(spark, sf):
    _, songs, sections, _, sums = parts_of(spark, sf)
    return song.sections_with_energy(sections, songs, sums, "axis", STEP).withColumn("energy", F.round("energy", 3))


ZONES = f"""d AS (SELECT d.axis, time, strength, beat // 4 AS tol, beat * 4 AS bar,
  CASE WHEN x."end" > time + beat // 4 THEN least(time + 4 * 4 * beat, x."end") ELSE time + 4 * 4 * beat END AS drop_end
  FROM drops d JOIN songs USING (axis) LEFT JOIN sections x ON x.axis = d.axis AND x.start <= time + beat // 4 AND time + beat // 4 < x."end"),
b AS (SELECT *, greatest(coalesce(lag(drop_end) OVER (PARTITION BY axis ORDER BY time), 0), time - 4 * bar) AS build FROM d),
w AS (SELECT axis, time, build AS ws, time AS we, 'buildup' AS kind FROM b WHERE time - build > tol UNION ALL SELECT axis, time, time, drop_end, 'drop' FROM b),
hit AS (SELECT p.axis, p.i, arg_min({{'kind': kind, 'we': we}}, (time, kind)) AS w FROM beats p JOIN songs USING (axis) JOIN w ON w.axis = p.axis AND ws <= p.t + beat // 4 AND p.t + beat // 4 < we GROUP BY ALL),
zoned AS (SELECT p.axis, p.i, p.t, beat, w, coalesce(x.label, l.label) AS section FROM beats p JOIN songs USING (axis) LEFT JOIN hit ON hit.axis = p.axis AND hit.i = p.i
  LEFT JOIN sections x ON x.axis = p.axis AND x.start <= p.t + beat // 4 AND p.t + beat // 4 < x."end"
  LEFT JOIN (SELECT axis, arg_max(label, start) AS label, max("end") AS upto FROM sections GROUP BY axis) l ON l.axis = p.axis AND p.t + beat // 4 >= upto),
zones AS (SELECT axis, i, t, coalesce(w.kind, section, 'verse') AS label, CASE WHEN w.kind = 'drop' THEN 0.5::DOUBLE
  WHEN w.kind = 'buildup' THEN [4.0::DOUBLE, 2.0, 2.0, 1.0][greatest(0, 3 - (w.we - t - beat // 4) // (4 * beat)) + 1]
  ELSE CASE section WHEN 'intro' THEN 4.0::DOUBLE WHEN 'chorus' THEN 1.0 WHEN 'outro' THEN 4.0 ELSE 2.0 END END AS rate FROM zoned)"""


def zones_of(beats, songs, sections, drops):
    return song.zones_per_beat(beats, songs, sections, drops, "axis", RULES)


@query("zones_per_beat", f"WITH {SONG}, {ZONES} SELECT axis, i, label, rate FROM zones")
def zones_per_beat(spark, sf):
    beats, songs, sections, drops, _ = parts_of(spark, sf)
    return zones_of(beats, songs, sections, drops).select("axis", "i", "label", "rate")


SHIFT = round(0.4 * LENGTH)
START = f"""main AS (SELECT axis, arg_max(time, (strength, -time)) AS main FROM drops GROUP BY axis), cho AS (SELECT axis, min(start) AS chorus FROM sections WHERE label = 'chorus' GROUP BY axis),
aim AS (SELECT s.axis, duration, coalesce(main - {SHIFT}, chorus - {SHIFT}, 0) AS target FROM songs s LEFT JOIN main USING (axis) LEFT JOIN cho USING (axis) WHERE duration >= {LENGTH}),
starts AS (SELECT aim.axis, coalesce(arg_min(t, (abs(t - target), t)), 0) AS song_start FROM aim LEFT JOIN beats b ON b.axis = aim.axis AND b.i % 4 = 0 AND b.t <= duration - {LENGTH} GROUP BY aim.axis)"""


def starts_of(beats, songs, sections, drops):
    down = beats.where("i % 4 = 0").select("axis", F.col("t").alias("d"))
    return down, song.edit_starts(songs, beats, down, sections, drops, "axis", LENGTH)


@query("edit_start", f"WITH {SONG}, {START} SELECT axis, song_start FROM starts")
def edit_start(spark, sf):
    beats, songs, sections, drops, _ = parts_of(spark, sf)
    return starts_of(beats, songs, sections, drops)[1]


SLOT = f"""z AS (SELECT z.*, count(*) OVER (PARTITION BY axis) AS n, lead(t) OVER o - t AS gap, label IS DISTINCT FROM lag(label) OVER o OR rate IS DISTINCT FROM lag(rate) OVER o AS turn FROM zones z WINDOW o AS (PARTITION BY axis ORDER BY i)),
y AS (SELECT z.*, coalesce(min(CASE WHEN turn THEN i END) OVER (PARTITION BY axis ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS change, song_start, song_start + {LENGTH} AS song_end,
  CASE WHEN gap IS NULL OR rate >= 1 OR gap * rate >= {2 * HOUR} THEN rate ELSE 1.0 END AS own FROM z JOIN starts USING (axis)),
f AS (SELECT axis, arg_min(i, (abs(t - song_start), i)) AS first FROM y GROUP BY axis),
nodes AS (SELECT axis, i * 8 + r AS node, t + coalesce(gap * r, 0) // 8 AS place, least(i * 8 + r + CAST(own * 8 AS BIGINT), change * 8) AS next, label, first, song_start, song_end
  FROM (SELECT y.*, first, unnest(range(0, 8)) AS r FROM y JOIN f USING (axis)) WHERE (r = 0 OR gap IS NOT NULL) AND i >= first),
walk AS (SELECT axis, node FROM nodes WHERE node = first * 8 UNION ALL SELECT n.axis, n.next FROM walk w JOIN nodes n ON n.axis = w.axis AND n.node = w.node
  JOIN nodes m ON m.axis = n.axis AND m.node = n.next WHERE m.place < m.song_end - {MIN_SLOT}),
cuts AS (SELECT *, row_number() OVER c - 1 AS slot_no, CASE WHEN row_number() OVER c = 1 THEN song_start ELSE place END AS t0 FROM nodes JOIN walk USING (axis, node) WINDOW c AS (PARTITION BY axis ORDER BY node)),
timed_cuts AS (SELECT *, coalesce(lead(t0) OVER (PARTITION BY axis ORDER BY node), song_end) AS t1 FROM cuts),
slots AS (SELECT axis, slot_no, node, t0, t1, t0 - song_start AS start, t1 - song_start AS "end", label AS section, round(mean, 3) AS intensity FROM {_mean('r.t0', 'r.t1', 'timed_cuts')}),
inside AS (SELECT s.axis, slot_no, b.t - t0 AS hit, NOT EXISTS (SELECT 1 FROM beats d WHERE d.axis = b.axis AND d.i % 4 = 0 AND abs(d.t - b.t) < beat // 4) AS off
  FROM slots s JOIN beats b ON b.axis = s.axis AND b.i * 8 >= node AND b.t > t0 AND b.t < t1 JOIN songs ON songs.axis = b.axis),
hits AS (SELECT axis, slot_no, string_agg(CAST(hit AS VARCHAR), ',' ORDER BY off, hit) AS hits FROM inside GROUP BY ALL)"""


def slots_of(spark, sf, parts=None):
    beats, songs, sections, *more = parts or parts_of(spark, sf)
    drops, sums = (written(df, "song") for df in more)
    down, starts = starts_of(beats, songs, sections, drops)
    return song.song_slots(zones_of(beats, songs, sections, drops), songs, down, sums, starts, "axis", LENGTH, RULES, STEP, MIN_SLOT)


WALKED = f"WITH RECURSIVE {SONG}, {ZONES}, {START}, {SLOT}"


@query("song_slots", f"{WALKED} SELECT s.axis, s.slot_no, start, \"end\", section, intensity, concat_ws(',', '0', hits) AS hits FROM slots s LEFT JOIN hits h ON h.axis = s.axis AND h.slot_no = s.slot_no")
def song_slots(spark, sf):
    s = slots_of(spark, sf)
    return s.withColumns({"intensity": F.round("intensity", 3), "hits": F.array_join(F.transform("hits", lambda h: h.cast("string")), ",")})


@query("song_slot_summary", f"{WALKED} SELECT axis, section, count(*) AS n, round(sum(\"end\" - start) / count(*), 3) AS mean, min(slot_no) AS first FROM slots GROUP BY axis, section")
def song_slot_summary(spark, sf):
    return song.slot_summary(slots_of(spark, sf), "axis").withColumn("mean", F.round("mean", 3))


# Shared segments ---------------------------------------------------------------------------------------------------------------
HALF_DAY, ALIKE = 12 * HOUR, 0.73
KINDS = ("view", "click", "purchase", "signup", "error")


def frames_of(spark, sf):
    """Every user as a series of half days, each a vector of how often each kind of event happened."""
    count = [F.count_if(F.col("event_type") == k) for k in KINDS]
    counted = spans(spark, sf).groupBy(F.col("axis").alias("series"), F.expr(f"s div {HALF_DAY}").alias("at")).agg(F.array(*[c.cast("double") for c in count]).alias("v"))
    return counted.select("series", (F.col("at") - F.min("at").over(Window.partitionBy("series"))).alias("i"), "v")


@query(
    "shared_segments",
    f"""WITH {SPANS}, f AS (SELECT axis, i, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS)} FROM
  (SELECT axis, s // {HALF_DAY} - min(s // {HALF_DAY}) OVER (PARTITION BY axis) AS i, event_type FROM spans) GROUP BY axis, i),
m AS (SELECT a.axis AS a, b.axis AS b, b.i - a.i AS k, a.i FROM f a JOIN f b ON b.axis - a.axis IN (1, 2, 3)
  WHERE ({' + '.join(f'a.{k} * b.{k}' for k in KINDS)}) / sqrt(({' + '.join(f'a.{k} * a.{k}' for k in KINDS)}) * ({' + '.join(f'b.{k} * b.{k}' for k in KINDS)})) >= {ALIKE}),
c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY a, b, k) AS hits FROM m) WHERE hits >= 8 * 0.5),
g AS (SELECT *, CASE WHEN i - lag(i) OVER w > 3 THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY a, b, k ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY a, b, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT a, b, k, min(i) AS first, max(i) - min(i) + 1 AS length, count(*) AS n FROM r GROUP BY a, b, k, run),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b, k ORDER BY length DESC, first) AS pos FROM runs) WHERE pos = 1 AND length BETWEEN 8 AND 40 AND n / length >= 0.5)
SELECT a, b, first AS start_a, first + k AS start_b, length, round(n / length, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY length DESC, k) AS best FROM longest) WHERE best = 1""",
)
def shared_segments(spark, sf):
    """Each user against the three next ones, as an episode against the nearest others."""
    frames = frames_of(spark, sf)
    users = spans(spark, sf).select(F.col("axis").alias("a")).distinct()
    pairs = users.select("a", F.explode(F.array(*[F.col("a") + d for d in (1, 2, 3)])).alias("b")).join(users.select(F.col("a").alias("b")), "b")
    return matching.shared_segments(frames, pairs, ALIKE, 8, 40, 2, 0.5).withColumn("coverage", F.round("coverage", 6))


# Clips ---------------------------------------------------------------------------------------------------------------------------
HOURS = f"""{SPANS}, counted AS (SELECT axis, s // {HOUR} - min(s // {HOUR}) OVER (PARTITION BY axis) AS i, CAST(floor(value) AS BIGINT) AS v FROM spans),
sizes AS (SELECT axis, max(i) AS n FROM counted GROUP BY axis),
curve AS (SELECT x.axis, x.i, coalesce(v, 0) AS value FROM (SELECT axis, unnest(range(0, n + 1)) AS i FROM sizes) x LEFT JOIN (SELECT axis, i, CAST(sum(v) AS BIGINT) AS v FROM counted GROUP BY ALL) y ON x.axis = y.axis AND x.i = y.i),
cl AS (SELECT axis, seg, s - (min(s // {HOUR}) OVER (PARTITION BY axis)) * {HOUR} AS a, e - (min(s // {HOUR}) OVER (PARTITION BY axis)) * {HOUR} AS z FROM spans)"""


def hours_of(spark, sf):
    """An hourly curve for each user, 0 where nothing happens, and the user's events as clips on it."""
    zero = F.min(F.expr(f"s div {HOUR}")).over(Window.partitionBy("axis"))
    s = spans(spark, sf).withColumn("zero", zero)
    counted = s.groupBy("axis", (F.expr(f"s div {HOUR}") - F.col("zero")).alias("i")).agg(F.sum(F.floor("value")).alias("value"))
    dense = counted.groupBy("axis").agg(F.max("i").alias("n")).select("axis", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("i"))
    own = s.select("axis", "seg", (F.col("s") - F.col("zero") * HOUR).alias("start"), (F.col("e") - F.col("zero") * HOUR).alias("end"))
    return dense.join(counted, ["axis", "i"], "left").select("axis", "i", F.coalesce("value", F.lit(0).cast("long")).alias("value")), own


@query(
    "clip_motion",
    f"""WITH {HOURS}, f AS (SELECT axis, seg, (a + {HOUR - 1}) // {HOUR} AS f0, least(n, z // {HOUR}) AS l0, (a + {3 * HOUR - 1}) // {HOUR} AS f1, least(least(n, z // {HOUR}), (z - {2 * HOUR}) // {HOUR}) AS l1 FROM cl JOIN sizes USING (axis)),
g AS (SELECT axis, seg, CASE WHEN l1 - f1 >= 1 THEN f1 ELSE f0 END AS a, CASE WHEN l1 - f1 >= 1 THEN l1 ELSE l0 END AS z FROM f WHERE f0 <= l0),
v AS (SELECT g.axis, seg, c.i, value, sum(value) OVER (PARTITION BY g.axis, seg ORDER BY c.i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around, count(*) OVER (PARTITION BY g.axis, seg) AS n FROM g JOIN curve c ON c.axis = g.axis AND c.i BETWEEN a AND z),
h AS (SELECT *, CASE WHEN n >= 3 THEN around ELSE value END AS height FROM v)
SELECT axis, seg, round(avg(value), 4) AS motion, arg_max(i, (height, -i)) * {HOUR} AS peak FROM h GROUP BY axis, seg""",
)
def clip_motion(spark, sf):
    curve, own = hours_of(spark, sf)
    return clips.clip_motion(own, curve, "axis", "seg", HOUR, edge=2 * HOUR, smooth=3)


FRAMES = f"""c AS (SELECT axis, seg, a / {HOUR}.0::DOUBLE AS a, z / {HOUR}.0::DOUBLE AS z FROM cl), n AS (SELECT *, (z - 0.5::DOUBLE) - (a + 0.5::DOUBLE) AS inside, CAST(least(3, floor((z - a) / 2.0::DOUBLE) + 1) AS INT) AS k FROM c),
t AS (SELECT axis, seg, CASE WHEN inside < 0.25 THEN [(a + z) / 2] ELSE [(a + 0.5::DOUBLE) + (x + 0.5::DOUBLE) * (inside / k) FOR x IN range(0, k)] END AS times FROM n),
f AS (SELECT axis, seg, [CAST(round_even(x * 4.0::DOUBLE, 0) AS BIGINT) FOR x IN times] AS all_frames FROM t),
d AS (SELECT axis, seg, list_sort(list_distinct(all_frames)) AS fs FROM f)"""


@query("plan_frames", f"WITH {HOURS}, {FRAMES} SELECT axis, seg, unnest(fs) AS frame, unnest([x = fs[len(fs) // 2 + 1] FOR x IN fs]) AS thumbnail FROM d")
def plan_frames(spark, sf):
    return frames_planned(spark, sf)


def frames_planned(spark, sf):
    own = hours_of(spark, sf)[1]
    in_hours = own.select("axis", "seg", (F.col("start") / float(HOUR)).alias("start"), (F.col("end") / float(HOUR)).alias("end"))
    return clips.plan_frames(in_hours, "axis", "seg", 4.0, 0.5, 2.0, 3)


@query("frame_owners", f"WITH {HOURS}, {FRAMES}, p AS (SELECT axis, seg, unnest(fs) AS frame, unnest([x = fs[len(fs) // 2 + 1] FOR x IN fs]) AS thumbnail FROM d) SELECT axis, frame, string_agg(seg || CASE WHEN thumbnail THEN '*' ELSE '' END, ',' ORDER BY seg) AS owners FROM p GROUP BY axis, frame")
def frame_owners(spark, sf):
    o = clips.frame_owners(frames_planned(spark, sf), "axis", "seg")
    return o.withColumn("owners", F.array_join(F.transform("owners", lambda x: F.concat(x["seg"].cast("string"), F.when(x["thumbnail"], "*").otherwise(""))), ","))


# Media ---------------------------------------------------------------------------------------------------------------------------
def payloads(spark, sf):
    """Every part as a media entry in JSON: a prequel, and a sequel some parts on that may be of another kind."""
    edge = lambda kind, to, type_, format_: F.struct(F.lit(kind).alias("relationType"), F.struct(to.alias("id"), type_.alias("type"), format_.alias("format")).alias("node"))
    size, key = F.col("p_size"), F.col("p_partkey")
    season = F.when(size % 9 == 0, "MOVIE").otherwise("TV")
    edges = F.array(
        edge("PREQUEL", key - 1, F.lit("ANIME"), F.lit("TV")), edge("SEQUEL", key + 3, F.when(size % 7 == 0, "MANGA").otherwise("ANIME"), season), edge("SEQUEL", key + 1 + size % 5, F.lit("ANIME"), F.lit("ONA"))
    )
    media_ = F.struct(
        key.alias("id"), (key * 2).alias("idMal"), F.when(size % 4 == 0, "MOVIE").otherwise("TV").alias("format"), F.struct(F.col("p_type").alias("romaji"), F.when(size % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("english")).alias("title"),
        F.array(F.col("p_brand")).alias("synonyms"), F.struct(edges.alias("edges")).alias("relations"),
    )
    return table(spark, sf, "part").select(F.col("p_brand").alias("search"), (F.col("p_retailprice") % 100 / 100).alias("score"), F.to_json(media_).alias("payload"))


SEQUEL = "CASE WHEN p_size % 7 <> 0 AND p_size % 9 <> 0 THEN p_partkey + 3 ELSE p_partkey + 1 + p_size % 5 END"


@query("parse_media", f"SELECT p_partkey AS id, p_partkey * 2 AS mal_id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS title, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 3 END AS titles, {SEQUEL} AS sequel_id FROM part")
def parse_media(spark, sf):
    m = payloads(spark, sf).select(media.parse_media(F.col("payload")).alias("m"))
    return m.select("m.id", "m.mal_id", "m.title", F.size("m.titles").alias("titles"), "m.sequel_id")


@query(
    "season_of",
    f"""WITH RECURSIVE c AS (SELECT p_brand AS search, p_partkey AS id, p_retailprice % 100 / 100 AS score FROM part WHERE p_size % 4 <> 0),
best AS (SELECT search, arg_min(id, (-score, id)) AS first, max(score) AS score FROM c GROUP BY search),
asked AS (SELECT search, number, first FROM (SELECT search, first, unnest(range(1, 41)) AS number FROM best WHERE score >= 0.75)),
links AS (SELECT p_partkey AS id, {SEQUEL} AS next FROM part),
walk AS (SELECT search, number, first, first AS here, 1 AS step FROM asked UNION ALL SELECT search, number, first, next, step + 1 FROM walk JOIN links ON id = here WHERE step < number)
SELECT a.search, a.number, a.first, w.here AS found FROM asked a LEFT JOIN walk w ON w.search = a.search AND w.number = a.number AND w.step = a.number""",
)
def season_of(spark, sf):
    """Seasons 1 to 40 of the best match of each brand."""
    m = payloads(spark, sf).select("search", "score", media.parse_media(F.col("payload")).alias("m")).select("search", "score", "m.id", "m.format", "m.sequel_id")
    m = written(m, "media")
    searches = m.select("search").distinct().select("search", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))).alias("number"))
    candidates = m.where(F.col("format").isin(*media.SEASON_FORMATS)).select("search", "id", "score", F.col("id").alias("place"))
    return media.season_of(searches, candidates, m.select("id", F.col("sequel_id").alias("next")))


# Songs for a season ----------------------------------------------------------------------------------------------------------------
STYLE = songs_for.Style(mood={"action": 1.0, "calm": -0.5, "funny": 0.25}, bpm=(100.0, 140.0), song_drop=0.75, drop_full=200.0)


def library(spark, sf):
    """Every user as a song, for each season: moods by the kinds of its events, the cuts of its edit and the strongest drop in it, the profile and size of the season's pool."""
    beats, songs, sections, drops, _ = parts = parts_of(spark, sf)
    _, starts = starts_of(beats, songs, sections, drops)
    inside = drops.join(starts, "axis").where((F.col("time") >= F.col("song_start")) & (F.col("time") < F.col("song_start") + LENGTH)).groupBy("axis").agg(F.max("strength").alias("drop"))
    cuts = slots_of(spark, sf, parts).groupBy("axis").agg(F.count("*").alias("cuts"))
    share = lambda k: F.round(F.count_if(F.col("event_type") == k) / F.count("*"), 3)
    moods = spans(spark, sf).groupBy("axis").agg(F.struct(*[share(k).alias(m) for m, k in zip(MOODS, KINDS)]).alias("moods"))
    own = songs.join(cuts, "axis").join(inside, "axis", "left").join(moods, "axis")
    own = own.select(
        F.col("axis").alias("song"), F.concat(F.lit("Artist "), F.col("axis") % 12).alias("artist"), F.concat(F.lit("Song "), F.col("axis") % 40).alias("label"), "duration",
        (60 + F.expr("beat div 1000000") % 120).cast("double").alias("bpm"), "cuts", "drop", "moods",
    )
    half = F.lit(0.5)
    of = {"action": F.round(F.avg("action"), 3), "calm": F.round(F.avg("calm"), 3)}
    seasons = top_pool(spark, sf).groupBy("season").agg(F.count("*").alias("pool"), *[c.alias(k) for k, c in of.items()])
    seasons = seasons.select("season", (F.col("pool") / 60).alias("pool"), F.when(F.col("season") != "5-LOW", F.struct(*[(F.col(m) if m in of else half).alias(m) for m in MOODS])).alias("profile"))
    # A row for each song and season, by an equi-join of the songs with the few seasons of each slice of them.
    return own.withColumn("season", F.explode(F.array(*map(F.lit, SEASONS)))).join(seasons, "season").withColumnRenamed("season", "season_key")


SEASONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_OFF = "(CASE WHEN bpm / {f} < 100 THEN 100 / (bpm / {f}) WHEN bpm / {f} > 140 THEN (bpm / {f}) / 140 ELSE 1.0::DOUBLE END)"
_OWN, _SCENES = [f"m{k}" for k in range(5)], ["0.5::DOUBLE", "action", "0.5::DOUBLE", "0.5::DOUBLE", "calm"]
_MEAN = {"o": f"(({' + '.join(_OWN)}) / 5)", "s": f"(({' + '.join(_SCENES)}) / 5)"}
_DOT = " + ".join(f"({a} - {_MEAN['o']}) * ({b} - {_MEAN['s']})" for a, b in zip(_OWN, _SCENES))
_NORM = f"sqrt(({' + '.join(f'({a} - {_MEAN['o']}) * ({a} - {_MEAN['o']})' for a in _OWN)}) * ({' + '.join(f'({b} - {_MEAN['s']}) * ({b} - {_MEAN['s']})' for b in _SCENES)}))"


def _out(values: list[str], mean: str) -> str:
    items = ", ".join(f"{{'v': -({v}), 'i': {i}, 'm': '{m}'}}" for i, (v, m) in enumerate(zip(values, MOODS)))
    return f"array_to_string(list_transform(list_sort(list_filter([{items}], lambda x: -x.v > {mean})), lambda x: x.m)[1:2], ',')"


RATED = f"""WITH RECURSIVE {SONG}, {ZONES}, {START}, {SLOT}, {POOL},
inside_drops AS (SELECT axis, max(strength) AS strongest FROM drops JOIN starts USING (axis) WHERE time >= song_start AND time < song_start + {LENGTH} GROUP BY axis),
lib AS (SELECT s.axis AS song, 'Artist ' || s.axis % 12 AS artist, 'Song ' || s.axis % 40 AS label, duration, CAST(60 + beat // 1000000 % 120 AS DOUBLE) AS bpm, c.cuts, strongest,
  {', '.join(f"m.{x}" for x in _OWN)} FROM songs s JOIN (SELECT axis, count(*) AS cuts FROM slots GROUP BY axis) c USING (axis) LEFT JOIN inside_drops USING (axis)
  JOIN (SELECT axis, {', '.join(f"round(count(*) FILTER (event_type = '{k}') / count(*), 3) AS m{i}" for i, k in enumerate(KINDS))} FROM spans GROUP BY axis) m USING (axis)),
prof AS (SELECT season, count(*) / 60 AS pool, round(avg(action), 3) AS action, round(avg(calm), 3) AS calm FROM pool GROUP BY season),
j AS (SELECT *, round({_OFF.format(f='1.0::DOUBLE')}, 6) AS d1, round({_OFF.format(f='2.0::DOUBLE')}, 6) AS d2, round({_OFF.format(f='0.5::DOUBLE')}, 6) AS d3 FROM lib, prof),
g AS (SELECT *, CASE WHEN d1 = least(d1, d2, d3) THEN 1.0::DOUBLE WHEN d2 = least(d1, d2, d3) THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS factor FROM j),
p AS (SELECT *, round(greatest(0.0, least(1.0, (1.0::DOUBLE * m1 + -0.5::DOUBLE * m4 + 0.25::DOUBLE * m3 + 0.5::DOUBLE) / 1.75::DOUBLE)), 3) AS mood,
  CASE WHEN season = '5-LOW' THEN 0.5::DOUBLE ELSE round(CASE WHEN {_NORM} > 1e-12 THEN (1.0::DOUBLE + ({_DOT}) / {_NORM}) / 2 ELSE 0.5::DOUBLE END, 3) END AS season_part,
  round(greatest(0, 1 - ({_OFF.format(f='factor')} - 1) / 0.4::DOUBLE) * CASE WHEN factor = 1 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END, 3) AS tempo,
  round(least(1.0::DOUBLE, coalesce(strongest / 200.0::DOUBLE, 0)), 3) AS drop_part, round(least(1.0::DOUBLE, pool / greatest(1.0::DOUBLE, cuts * 2.0::DOUBLE)), 3) AS material FROM g),
rated AS (SELECT *, CASE WHEN season = '5-LOW' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS ws,
  round((1.0::DOUBLE * mood + CASE WHEN season = '5-LOW' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END * season_part + 0.5::DOUBLE * tempo + 0.375::DOUBLE * drop_part + 0.5::DOUBLE * material)
    / (1.0::DOUBLE + CASE WHEN season = '5-LOW' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END + 0.5::DOUBLE + 0.375::DOUBLE + 0.5::DOUBLE), 3) AS score FROM p)"""


def rated_of(spark, sf):
    return written(songs_for.rate(written(library(spark, sf), "library"), STYLE), "rated")


@query("suggest_rate", f"{RATED} SELECT season, song, mood, season_part, tempo, drop_part, material, factor, cuts, score FROM rated")
def suggest_rate(spark, sf):
    r = rated_of(spark, sf)
    # The part named like the key of the season is told apart.
    return r.select(F.col("season_key").alias("season"), "song", "mood", F.col("season").alias("season_part"), "tempo", F.col("drop").alias("drop_part"), "material", "factor", "cuts", "score")


_GOOD = [("mood", "1.0", "mood >= 0.6"), ("season", "ws", "season <> '5-LOW' AND scenes <> '' AND season_part >= 0.7 AND own <> scenes"), ("tempo", "0.5", "tempo >= 0.7"), ("drop", "0.375", "strongest IS NOT NULL AND drop_part >= 0.7")]
_BAD = [("mood", "1.0", "mood < 0.45"), ("season", "ws", "season <> '5-LOW' AND scenes <> '' AND season_part < 0.45"), ("tempo", "0.5", "tempo < 0.45"), ("drop", "0.375", "drop_part < 0.45"), ("material", "0.5", "material < 0.45")]


def _listed(rules: list, value: str, n: int) -> str:
    col = {"season": "season_part", "drop": "drop_part"}
    items = ", ".join(f"{{'v': -({w}::DOUBLE * ({value.format(v=col.get(k, k))})), 'i': {i}, 'k': '{k}', 'ok': {test}}}" for i, (k, w, test) in enumerate(rules))
    return f"array_to_string(list_transform(list_sort(list_filter([{items}], lambda x: x.ok)), lambda x: x.k)[1:{n}], ',')"


@query("suggest_explain", f"{RATED}, named AS (SELECT *, {_out(_OWN, _MEAN['o'])} AS own, {_out(_SCENES, _MEAN['s'])} AS scenes FROM rated) SELECT season, song, {_listed(_GOOD, '{v}', 3)} AS reasons, {_listed(_BAD, '1 - {v}', 2)} AS concerns FROM named")
def suggest_explain(spark, sf):
    e = songs_for.explain(rated_of(spark, sf), STYLE)
    return e.select(F.col("season_key").alias("season"), "song", F.array_join("reasons", ",").alias("reasons"), F.array_join("concerns", ",").alias("concerns"))


@query(
    "suggest_topk_capped",
    f"""{RATED}, n AS (SELECT *, row_number() OVER (PARTITION BY season, artist ORDER BY score DESC, lower(label), song) AS nth FROM rated WHERE duration >= {LENGTH}),
t AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY score DESC, lower(label), song) AS place FROM n WHERE nth <= 2) SELECT season, place, song, artist, score FROM t WHERE place <= 10""",
)
def suggest_topk_capped(spark, sf):
    s = songs_for.suggest(rated_of(spark, sf), ["season_key"], LENGTH, top=10)
    return s.select(F.col("season_key").alias("season"), "place", "song", "artist", "score")


# Effects ---------------------------------------------------------------------------------------------------------------------------
ZONE_NAMES = ("verse", "buildup", "drop", "drop", "chorus", "chorus", "outro")
CUTS = fx.Transitions("crossfade", downbeat="flash", section="whip", drop="dip_white", beats=0.75)
RAMP, SLOW, FREEZE = fx.Rule(("verse", "buildup"), 0.6, (0.5, 2.0, 0.25)), fx.Rule((), 3.0, (0.75,)), fx.Rule(("outro", "chorus"), 1.0, (0.25,))
PUNCH, SHAKE, PUSH = fx.Rule(("drop", "chorus"), 0.0, (0.12,), at="downbeats"), fx.Rule(("drop",), 0.0, (0.02,)), fx.Rule((), 4.0, (0.06,))


def edited_slots(spark, sf):
    """The slots of each user's events on a grid of quarter seconds, with zones in turn; every second clip is aligned, its peak half way."""
    s = uniform(spark, sf)
    first = F.min("start").over(Window.partitionBy("axis"))
    grid = lambda c: F.floor((F.col(c) - first) / (3 * HOUR)) * 0.25
    s = s.withColumns({"a": grid("start"), "z": grid("end")}).select("axis", "slot_no", F.col("a").alias("start"), F.col("z").alias("end")).where("end > start")
    zone = F.element_at(F.array(*map(F.lit, ZONE_NAMES)), ((F.col("axis") + F.col("slot_no")) % 7 + 1).cast("int"))
    hits = F.filter(F.array(*map(F.lit, (0.0, 0.5, 1.0, 1.5))), lambda h: h < F.col("end") - F.col("start"))
    s = s.withColumns({"section": zone, "hits": hits, "aligned": F.col("slot_no") % 2 == 0, "peak": (F.col("end") - F.col("start")) / 2})
    bars = s.groupBy("axis").agg(F.max("end").alias("last")).select("axis", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 2).cast("int"))).alias("k"))
    return s, bars.select("axis", (F.col("k") * 2.0).alias("d"))


EDITED = f"""{SLOTS}, q AS (SELECT axis, slot_no, floor((start - min(start) OVER w) / {3 * HOUR}) * 0.25::DOUBLE AS a, floor(("end" - min(start) OVER w) / {3 * HOUR}) * 0.25::DOUBLE AS z FROM slots WINDOW w AS (PARTITION BY axis)),
e AS (SELECT *, z - a AS size, {list(ZONE_NAMES)}[(axis + slot_no) % 7 + 1] AS section, list_filter([0.0::DOUBLE, 0.5, 1.0, 1.5], lambda h: h < z - a) AS hits FROM q WHERE z > a)"""


@query(
    "plan_transitions",
    f"""WITH {EDITED}, r AS (SELECT *, CAST(coalesce(lead(round_even(a * 24, 0)) OVER w, round_even(z * 24, 0)) - round_even(a * 24, 0) AS BIGINT) AS frames FROM e WINDOW w AS (PARTITION BY axis ORDER BY slot_no)),
n AS (SELECT *, lag(section) OVER w AS zone, lag(frames) OVER w AS before, a - floor(a / 2) * 2 < 0.125 AS down FROM r WINDOW w AS (PARTITION BY axis ORDER BY slot_no)),
wished AS (SELECT *, CASE WHEN before IS NULL THEN 'cut' WHEN section = 'drop' AND zone <> 'drop' THEN 'dip_white' WHEN section <> zone THEN 'whip' WHEN down THEN 'flash' ELSE 'crossfade' END AS wish FROM n),
l AS (SELECT *, CASE WHEN wish = 'cut' THEN 0 WHEN wish = 'flash' THEN CASE WHEN least(4, floor(0.5 * frames)) >= 2 THEN least(4, floor(0.5 * frames)) ELSE 0 END
  ELSE floor(floor(least(CASE WHEN wish = 'whip' THEN 4.8 ELSE 9.0 END, 0.5 * least(before, frames))) / 2) END AS length FROM wished)
SELECT axis, slot_no, frames, CASE WHEN length > 0 THEN wish ELSE 'cut' END AS kind, CAST(length AS INT) AS length, coalesce(lead(CASE WHEN length > 0 THEN wish ELSE 'cut' END) OVER w, 'cut') AS out_kind,
  CAST(coalesce(lead(length) OVER w, 0) AS INT) AS out_length FROM l WINDOW w AS (PARTITION BY axis ORDER BY slot_no)""",
)
def plan_transitions(spark, sf):
    s, bars = edited_slots(spark, sf)
    t = fx.transitions(s, bars, "axis", CUTS, 0.5, 24, flash=0.16)
    return t.select("axis", "slot_no", "frames", "kind", F.col("length").cast("int").alias("length"), "out_kind", F.col("out_length").cast("int").alias("out_length"))


@query(
    "plan_effects",
    f"""WITH {EDITED}, p AS (SELECT *, (section IN ('verse', 'buildup') AND size >= 0.6) AS ramp, (NOT (section IN ('verse', 'buildup') AND size >= 0.6) AND size >= 3) AS slow, (section IN ('outro', 'chorus') AND size >= 1) AS still,
  CASE WHEN section IN ('drop', 'chorus') THEN [k * 2.0 - a FOR k IN range(CAST(ceil((a - 0.125) / 2) AS BIGINT), CAST(ceil((z - 0.125) / 2) AS BIGINT))] ELSE [] END AS punches FROM e),
f AS (SELECT *, CASE WHEN still AND len(hits) > 1 THEN list_concat(list_transform(list_sort([{{'d': abs(h - 0.6::DOUBLE * size), 'h': h}} FOR h IN list_filter(hits, lambda h: h >= 0.3::DOUBLE * size)]), lambda x: x.h), list_filter(hits, lambda h: h < 0.3::DOUBLE * size)) ELSE hits END AS moved,
  CASE WHEN ramp THEN NULL WHEN slow THEN size / 2 / 0.75 ELSE size / 2 END AS peak_at FROM p),
c AS (SELECT *, (still AND slot_no % 2 = 0 AND peak_at >= 0.25 * size AND peak_at <= size - 0.3) AS frozen FROM f)
SELECT axis, slot_no, array_to_string(moved, ',') AS hits, array_to_string([greatest(0.0, round(x, 4)) FOR x IN punches], ',') AS punches, CASE WHEN section = 'drop' THEN 0.02::DOUBLE ELSE 0.0 END AS shake, CASE WHEN size >= 4 THEN 0.06::DOUBLE ELSE 0.0 END AS push_in,
  CASE WHEN frozen THEN round(peak_at, 4) END AS freeze_at,
  array_to_string(list_filter([CASE WHEN ramp THEN 'tempo 0.5x>2x' WHEN slow THEN 'tempo 0.75x' END, CASE WHEN len(punches) > 0 THEN 'zoom_punch x' || len(punches) END, CASE WHEN section = 'drop' THEN 'shake' END, CASE WHEN size >= 4 THEN 'push_in' END,
    CASE WHEN frozen THEN 'freeze' END], lambda x: x IS NOT NULL), ', ') AS labels FROM c""",
)
def plan_effects(spark, sf):
    s, bars = edited_slots(spark, sf)
    e = fx.effects(fx.prepare(s, RAMP, SLOW, FREEZE), bars, "axis", 0.5, PUNCH, SHAKE, PUSH, FREEZE)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return e.select("axis", "slot_no", text("hits"), text("punches"), "shake", "push_in", "freeze_at", F.array_join("labels", ", ").alias("labels"))


# Detector output -------------------------------------------------------------------------------------------------------------------
@query(
    "decode_boxes",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
r AS (SELECT vec_id, k, v[k * 6 + 1] AS x, v[k * 6 + 2] AS y, v[k * 6 + 3] - v[k * 6 + 1] AS w, v[k * 6 + 4] - v[k * 6 + 2] AS h, v[k * 6 + 5] AS score FROM (SELECT *, unnest(range(0, 10)) AS k FROM v WHERE vec_id % 2 = 0)),
c AS (SELECT vec_id, k, v[k + 1] - v[k + 17] / 2 AS x, v[k + 9] - v[k + 25] / 2 AS y, v[k + 17] AS w, v[k + 25] AS h, greatest(v[k + 33], v[k + 41], v[k + 49], v[k + 57]) AS score FROM (SELECT *, unnest(range(0, 8)) AS k FROM v WHERE vec_id % 2 = 1)),
b AS (SELECT * FROM r UNION ALL SELECT * FROM c)
SELECT vec_id, k AS box_id, score, round(greatest(0.0, least(1.0, (x + 0.25) / 0.5 / 1.6::DOUBLE)), 4) AS x0, round(greatest(0.0, least(1.0, (y + 0.5) / 0.5 / 2.0)), 4) AS y0,
  round(greatest(0.0, least(1.0, (x + w + 0.25) / 0.5 / 1.6::DOUBLE)), 4) AS x1, round(greatest(0.0, least(1.0, (y + h + 0.5) / 0.5 / 2.0)), 4) AS y1 FROM b WHERE score >= 0.1""",
)
def decode_boxes(spark, sf):
    """Every vector as the raw output of a detector: ten boxes by row, or eight by column with four classes."""
    even = F.col("vec_id") % 2 == 0
    raw = table(spark, sf, "embeddings").select("vec_id", F.when(even, 10).otherwise(8).alias("rows"), F.when(even, 6).otherwise(8).alias("columns"), F.col("embedding").alias("values"))
    return boxes.in_image(boxes.decode(raw, "vec_id", 0.1), 0.5, -0.25, -0.5, 1.6, 2.0)
