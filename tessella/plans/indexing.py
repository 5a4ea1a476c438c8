"""Queries over framings of shots and over the stages of an index: events are faces in shots of five days, documents are episodes of seasons of twenty."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import music
from tessella.operators import framing, media, people, stages
from tessella.operators.stages import Stage
from tessella.plans.queries import HOUR, SPANS, _sig, query, spans
from tessella.sources.readers import table

# Framing ---------------------------------------------------------------------------------------------------------------------------
DAY = 24 * HOUR
RULES = framing.FrameRules()
WIDE = 16 / 9


def faces_of(spark, sf):
    """Each event a face, at whole days, in shots of the middle days of five."""
    day = (F.col("s") - F.min("s").over(Window.partitionBy("axis"))).alias("t")
    e = spans(spark, sf).select("axis", "seg", F.floor(F.col("value") * 100).alias("v"), day)
    e = e.select("axis", "seg", "v", F.expr(f"t div {DAY}").alias("day"))
    x0 = (F.col("axis") * 37 % 500 + F.col("v") % 300) / 1000.0
    return e.select(
        "axis", F.expr("day div 5").alias("shot"), F.col("seg").alias("face_id"), F.col("day").cast("double").alias("time"), x0.alias("x0"), F.lit(0.25).alias("y0"),
        (x0 + (40 + F.col("seg") % 90) / 1000.0).alias("x1"), (F.lit(0.25) + (1 + F.col("v") % 7) / 16.0).alias("y1"), (F.col("seg") % 10 / 10.0).alias("probability"), (F.col("seg") % 11 == 0).alias("wanted"),
    )


def shots_of(faces):
    s = faces.groupBy("axis").agg(F.max("shot").alias("n")).select("axis", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("shot"))
    return s.select(
        "axis", "shot", (F.col("shot") * 5.0 + 1).alias("start"), (F.col("shot") * 5.0 + 3).alias("end"), F.when(F.col("shot") % 2 == 0, 2.0).otherwise(1.0).alias("duration"),
        F.when(F.col("axis") % 10 == 0, 0.5).otherwise(WIDE).alias("aspect"), F.when(F.col("axis") % 3 > 0, F.col("axis") % 100 / 100.0).alias("motion_x"),
    )


def _clamped(x: str) -> str:
    return f"least(greatest({x}, width / 2), 1.0::DOUBLE - width / 2)"


def _inside(x0: str, x1: str, center: str) -> str:
    return f"({x0} >= {center} - width / 2 - {RULES.slack}::DOUBLE AND {x1} <= {center} + width / 2 + {RULES.slack}::DOUBLE)"


FRAMED = f"""{SPANS}, e AS (SELECT axis, seg, CAST(floor(value * 100) AS BIGINT) AS v, (s - min(s) OVER (PARTITION BY axis)) // {DAY} AS day FROM spans),
face AS (SELECT axis, day // 5 AS shot, seg, day::DOUBLE AS t, (axis * 37 % 500 + v % 300) / 1000.0::DOUBLE AS x0, (axis * 37 % 500 + v % 300) / 1000.0::DOUBLE + (40 + seg % 90) / 1000.0::DOUBLE AS x1,
  0.25::DOUBLE + (1 + v % 7) / 16.0::DOUBLE AS y1, (seg % 10) / 10.0::DOUBLE AS p, seg % 11 = 0 AS want FROM e),
shot AS (SELECT axis, shot, shot * 5.0::DOUBLE + 1 AS a, shot * 5.0::DOUBLE + 3 AS z, CASE WHEN shot % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS duration, CASE WHEN axis % 10 = 0 THEN 1.0::DOUBLE ELSE {framing.UPRIGHT}::DOUBLE / {WIDE!r}::DOUBLE END AS width,
  CASE WHEN axis % 3 > 0 THEN (axis % 100) / 100.0::DOUBLE END AS motion FROM (SELECT axis, unnest(range(0, max(shot) + 1)) AS shot FROM face GROUP BY axis)),
n AS (SELECT *, t >= a - {RULES.around}::DOUBLE AND t <= z + {RULES.around}::DOUBLE AS near FROM face JOIN shot USING (axis, shot) WHERE width < 1),
m AS (SELECT *, y1 - 0.25::DOUBLE AS h, bool_or(want) OVER w AS wants, max(y1 - 0.25::DOUBLE) OVER w AS top FROM (SELECT *, bool_or(near) OVER (PARTITION BY axis, shot) AS any_near FROM n) WHERE near OR NOT any_near WINDOW w AS (PARTITION BY axis, shot)),
r AS (SELECT *, (x0 + x1) / 2 AS x, (0.25::DOUBLE + y1) / 2 AS y, least(greatest(t - a, 0.0), duration) AS tm FROM m WHERE CASE WHEN wants THEN want ELSE h >= top * {RULES.least_share}::DOUBLE END),
o AS (SELECT *, min(x0) OVER (PARTITION BY axis, shot, tm) AS lo, max(x1) OVER (PARTITION BY axis, shot, tm) AS hi, row_number() OVER (PARTITION BY axis, shot ORDER BY want DESC, h DESC, p DESC, seg) AS pos FROM r),
main AS (SELECT axis, shot, seg AS main, x AS mx, y AS my FROM o WHERE pos = 1),
q AS (SELECT o.*, mx, my, main, row_number() OVER (PARTITION BY axis, shot ORDER BY abs(x - mx) DESC, seg) AS off, min(x0) OVER w AS l, max(x1) OVER w AS r, max(hi - lo) OVER w AS wide, min(tm) OVER w < max(tm) OVER w AS several FROM o JOIN main USING (axis, shot) WINDOW w AS (PARTITION BY axis, shot)),
k AS (SELECT *, max(CASE WHEN off = 1 THEN x END) OVER (PARTITION BY axis, shot) AS far, CASE WHEN r - l <= width * {1 - 2 * RULES.margin!r}::DOUBLE THEN 'face' WHEN several AND wide <= width * {1 - 2 * RULES.margin!r}::DOUBLE THEN 'follow' WHEN duration >= {RULES.pan_from} THEN 'pan' ELSE 'main' END AS mode FROM q),
c AS (SELECT *, CASE mode WHEN 'face' THEN {_clamped('(l + r) / 2')} WHEN 'follow' THEN {_clamped('(lo + hi) / 2')} ELSE {_clamped('mx')} END AS center, {_clamped('far')} AS other FROM k),
v AS (SELECT *, {_inside('x0', 'x1', 'center')} OR (mode = 'pan' AND {_inside('x0', 'x1', 'other')}) AS seen, {_inside('x0', 'x1', '0.5::DOUBLE')} AS mid FROM c),
g AS (SELECT axis, shot, any_value(mode) AS mode, count(*) AS faces, count(*) FILTER (seen) AS inside, bool_or(seen) FILTER (seg = main) AS main_inside, count(*) FILTER (mid) AS center_inside, min(other) AS other, any_value(my) AS my,
  max(CASE WHEN seg = main THEN CASE WHEN mode = 'pan' THEN 0.5::DOUBLE ELSE (mx - (center - width / 2)) / width END END) AS fx,
  list_sort(list_distinct(list({{'at': CASE mode WHEN 'pan' THEN duration * 0.2::DOUBLE WHEN 'follow' THEN tm ELSE 0.0 END, 'center': center}}))) AS keys, any_value(duration) AS duration FROM v GROUP BY axis, shot),
framed AS (SELECT s.axis, s.shot, coalesce(CASE g.mode WHEN 'follow' THEN 'face' ELSE g.mode END, CASE WHEN width < 1 AND motion IS NOT NULL THEN 'motion' ELSE 'center' END) AS mode, width, coalesce(fx, 0.5) AS focus_x, coalesce(my, 0.5) AS focus_y,
  coalesce(faces, 0) AS faces, coalesce(inside, 0) AS inside, main_inside, coalesce(center_inside, 0) AS center_inside,
  CASE WHEN g.mode = 'pan' THEN list_append(keys, {{'at': g.duration * 0.8::DOUBLE, 'center': other}}) WHEN g.mode IS NOT NULL THEN keys
    ELSE [{{'at': 0.0::DOUBLE, 'center': CASE WHEN width < 1 AND motion IS NOT NULL THEN {_clamped('motion')} ELSE 0.5 END}}] END AS keys FROM shot s LEFT JOIN g ON g.axis = s.axis AND g.shot = s.shot)"""


def framed(spark, sf):
    faces = faces_of(spark, sf)
    return framing.frame_shots(shots_of(faces), faces, ["axis", "shot"], RULES)


@query("frame_shots", f"WITH {FRAMED} SELECT axis, shot, mode, round(width, 6) AS width, round(focus_x, 6) AS focus_x, round(focus_y, 6) AS focus_y, faces, inside, coalesce(main_inside, false) AS main_inside, center_inside FROM framed")
def frame_shots(spark, sf):
    return framed(spark, sf).drop("keys").withColumns({"main_inside": F.coalesce("main_inside", F.lit(False)), **{c: F.round(c, 6) for c in ("width", "focus_x", "focus_y")}})


@query("frame_keys", f"WITH {FRAMED} SELECT axis, shot, k['at'] AS \"at\", round(k['center'], 6) AS center FROM (SELECT axis, shot, unnest(keys) AS k FROM framed)")
def frame_keys(spark, sf):
    k = framed(spark, sf).select("axis", "shot", F.explode("keys").alias("k"))
    return k.select("axis", "shot", "k.at", F.round("k.center", 6).alias("center"))


@query(
    "framing_summary",
    f"WITH {FRAMED} SELECT axis, mode, count(*) AS shots, CAST(sum(faces) AS BIGINT) AS faces, CAST(sum(inside) AS BIGINT) AS inside, CAST(sum(center_inside) AS BIGINT) AS center_inside, count(main_inside) AS with_faces, count(*) FILTER (main_inside) AS main_inside FROM framed GROUP BY axis, mode",
)
def framing_summary(spark, sf):
    return framing.summary(framed(spark, sf), ["axis"])


# Stages ----------------------------------------------------------------------------------------------------------------------------
STAGES = [
    Stage("scenes", ("n_chars", "skips_source"), "scenes=3"), Stage("motion", ("scenes",), "motion=12"), Stage("visual", ("scenes",), "model=b"), Stage("tags", ("visual",), "prompts=2"), Stage("audio", ("scenes",), "audio=1"),
    Stage("subtitles", ("n_chars",), "lines=1"), Stage("mood", ("motion", "visual", "tags", "audio", "subtitles"), "mood=1", whole=True), Stage("faces", ("scenes",), "faces=1"), Stage("figures", ("faces",), "match=0.4", whole=True),
]
SEASON_OF = 20


def episodes_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(f"doc_id div {SEASON_OF}").alias("season"), "n_chars", F.col("source").alias("skips_source"))


def reset_of(spark, sf):
    """Of five seasons one gets another id and one loses its own; every third had none before."""
    e = episodes_of(spark, sf)
    season = F.col("season")
    before = e.select("season").distinct().withColumn("id", F.when(season % 3 > 0, season))
    after = before.select("season", F.when(season % 5 == 0, season + 1).when(season % 5 > 1, season).alias("id"))
    return stages.reset_changed(e, before, after, "season", "id", "skips_source")


RESET = f"reset AS (SELECT doc_id, doc_id // {SEASON_OF} AS season, n_chars, CASE WHEN (doc_id // {SEASON_OF}) % 3 > 0 AND (doc_id // {SEASON_OF}) % 5 <= 1 THEN NULL ELSE source END AS skips_source FROM documents)"


@query("reset_changed_ids", f"WITH {RESET} SELECT season, count(*) AS episodes, count(skips_source) AS kept FROM reset GROUP BY season")
def reset_changed_ids(spark, sf):
    return reset_of(spark, sf).groupBy("season").agg(F.count("*").alias("episodes"), F.count("skips_source").alias("kept"))


def _signed(name: str, source: str) -> str:
    """The steps of SQL that sign ``source``, one for each stage; the last is called ``name``."""
    steps, last = [], source
    for i, s in enumerate(STAGES):
        to = name if i == len(STAGES) - 1 else f"{name}_{i}"
        if s.whole:
            number = f"CAST('0x' || left({_sig('doc_id', *s.upstream)}, {stages.DIGITS}) AS BIGINT)"
            sign = _sig(f"(count(*) OVER (PARTITION BY season))", f"(sum({number}) OVER (PARTITION BY season))", f"'{s.settings}'")
        else:
            sign = _sig(*s.upstream, f"'{s.settings}'")
        steps.append(f"{to} AS (SELECT *, {sign} AS {s.name} FROM {last})")
        last = to
    return ", ".join(steps)


ADVANCED = f"""{RESET}, before AS (SELECT doc_id, doc_id // {SEASON_OF} AS season, CASE WHEN doc_id % 250 = 203 THEN n_chars + 1 ELSE n_chars END AS n_chars, source AS skips_source FROM documents),
{_signed('old_all', 'before')}, old AS (SELECT * FROM old_all WHERE doc_id % 170 <> 0), {_signed('fresh', 'reset')},
stale AS (SELECT f.doc_id, f.season, {', '.join(f'f.{s.name} IS DISTINCT FROM o.{s.name} AS {s.name}' for s in STAGES)} FROM fresh f LEFT JOIN old o ON o.doc_id = f.doc_id)"""


def advanced(spark, sf):
    """A run after ids of seasons changed, some texts are shorter than they were and some are new."""
    e = episodes_of(spark, sf)
    was = e.withColumn("n_chars", F.when(F.col("doc_id") % 250 == 203, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    stored = stages.signatures(was, "doc_id", "season", STAGES).where("doc_id % 170 <> 0")
    return stages.advance(reset_of(spark, sf), stored, "doc_id", "season", STAGES)


@query("stage_stale", f"WITH {ADVANCED} SELECT doc_id, season, concat_ws(',', {', '.join(f"CASE WHEN {s.name} THEN '{s.name}' END" for s in STAGES)}) AS stale FROM stale")
def stage_stale(spark, sf):
    return advanced(spark, sf).select("doc_id", "season", F.array_join("stale", ",").alias("stale"))


@query("stage_workload", f"WITH {ADVANCED} " + " UNION ALL ".join(f"SELECT season, '{s.name}' AS stage, {'1::BIGINT' if s.whole else 'count(*)'} AS n FROM stale WHERE {s.name} GROUP BY season" for s in STAGES))
def stage_workload(spark, sf):
    return stages.workload(advanced(spark, sf), "season", STAGES)


FOUND = """found AS (SELECT doc_id, kind, CASE kind WHEN 'op' THEN 1 ELSE n_chars - 90 END AS start, CASE kind WHEN 'op' THEN 91 ELSE n_chars END AS "end", CASE WHEN kind IS NULL THEN NULL WHEN (doc_id + length(kind)) % 3 = 0 THEN 'service+audio' WHEN doc_id % 2 = 0 THEN 'audio' ELSE 'service' END AS source
  FROM (SELECT doc_id, n_chars, unnest(CASE WHEN n_chars < 200 THEN [NULL] WHEN n_chars % 2 = 0 THEN ['op', 'ending'] ELSE ['op'] END) AS kind FROM documents WHERE doc_id % 3 > 0))"""


def skips_of(spark, sf):
    """Two of three documents are searched; all had an opening before."""
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    kinds = F.when(F.col("n") < 200, F.array(F.lit(None).cast("string"))).when(F.col("n") % 2 == 0, F.array(F.lit("op"), F.lit("ending"))).otherwise(F.array(F.lit("op")))
    f = d.where("doc_id % 3 > 0").select("doc_id", "n", F.explode(kinds).alias("kind"))
    op = F.col("kind") == "op"
    source = F.when(F.col("kind").isNull(), None).when((F.col("doc_id") + F.length("kind")) % 3 == 0, "service+audio").when(F.col("doc_id") % 2 == 0, "audio").otherwise("service")
    found = f.select("doc_id", "kind", F.when(op, 1).otherwise(F.col("n") - 90).alias("start"), F.when(op, 91).otherwise(F.col("n")).alias("end"), source.alias("source"))
    known = d.select("doc_id", F.lit("op").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(90).cast("long").alias("end"), F.lit("service").alias("source"))
    return stages.write_skips(known, found, "doc_id")


@query("skips_written", f"WITH {FOUND} SELECT * FROM found WHERE kind IS NOT NULL UNION ALL SELECT doc_id, 'op', 0, 90, 'service' FROM documents WHERE doc_id % 3 = 0")
def skips_written(spark, sf):
    return skips_of(spark, sf)[0]


@query("skips_source", f"WITH {FOUND} SELECT doc_id, coalesce(string_agg(DISTINCT part, '+' ORDER BY part), 'none') AS skips_source FROM (SELECT doc_id, unnest(coalesce(string_split(source, '+'), [NULL])) AS part FROM found) GROUP BY doc_id")
def skips_source(spark, sf):
    return skips_of(spark, sf)[1]


# Characters, spans and moods -------------------------------------------------------------------------------------------------------
CAST = """cast_ AS (SELECT p_brand AS season, p_partkey AS character_id, p_name AS name, p_size AS position, CASE p_partkey % 3 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'SUPPORTING' ELSE 'OTHER' END AS role, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS r FROM part),
names AS (SELECT DISTINCT p_brand AS season, p_type AS request, unnest([split_part(p_name, ' ', 2), p_name, split_part(p_name, ' ', 1)]) AS search FROM part),
hits AS (SELECT n.season, n.search, c.character_id, name, CASE WHEN name = search THEN 3 WHEN list_contains(string_split(name, ' '), search) THEN 2 ELSE 1 END AS score, row_number() OVER (PARTITION BY n.season, n.search ORDER BY CASE WHEN name = search THEN 3 WHEN list_contains(string_split(name, ' '), search) THEN 2 ELSE 1 END DESC, r, position, character_id) - 1 AS place
  FROM (SELECT DISTINCT season, search FROM names) n JOIN cast_ c ON c.season = n.season AND contains(name, search))"""


def cast_of(spark, sf):
    key = F.col("p_partkey")
    p = table(spark, sf, "part")
    characters = p.select(F.col("p_brand").alias("season"), key.alias("character_id"), F.col("p_name").alias("name"), F.when(key % 3 == 0, "MAIN").when(key % 3 == 1, "SUPPORTING").otherwise("OTHER").alias("role"), F.col("p_size").alias("position"))
    part = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    asked = p.select(F.col("p_brand").alias("season"), F.col("p_type").alias("request"), F.explode(F.array(part(2), F.col("p_name"), part(1))).alias("search"))
    return characters, asked.distinct()


@query("find_characters", f"WITH {CAST} SELECT season, search, character_id, score, place FROM hits")
def find_characters(spark, sf):
    """Whole names and their words, upper-cased, against the parts of each brand."""
    characters, asked = cast_of(spark, sf)
    found = people.find(asked.select("season", F.upper("search").alias("search")), characters, "season", "search")
    return found.select("season", F.lower("search").alias("search"), "character_id", "score", "place")


@query(
    "pick_characters",
    f"""WITH {CAST}, lists AS (SELECT season, request, search, row_number() OVER (PARTITION BY season, request ORDER BY search) - 1 AS position FROM (SELECT * FROM names UNION SELECT season, request, 'nobody' FROM names)),
m AS (SELECT l.*, h.character_id FROM lists l LEFT JOIN hits h ON h.season = l.season AND h.search = l.search AND place = 0),
o AS (SELECT season, search, string_agg(name, ',' ORDER BY place) AS others FROM hits WHERE place BETWEEN 1 AND 3 GROUP BY ALL)
SELECT m.season, request, position, m.search, coalesce(character_id, -1) AS character_id, CASE WHEN character_id IS NULL THEN 'unknown' WHEN row_number() OVER (PARTITION BY m.season, request, character_id ORDER BY position) > 1 THEN 'repeated' ELSE 'found' END AS status, coalesce(others, '') AS others
FROM m LEFT JOIN o ON o.season = m.season AND o.search = m.search""",
)
def pick_characters(spark, sf):
    characters, asked = cast_of(spark, sf)
    every = asked.unionByName(asked.select("season", "request", F.lit("nobody").alias("search"))).distinct()
    lists = every.groupBy("season", "request").agg(F.array_join(F.array_sort(F.collect_list("search")), ", ").alias("text"))
    p = people.pick(lists, characters, "season", "request", "text")
    return p.withColumns({"position": F.col("position").cast("long"), "character_id": F.coalesce("character_id", F.lit(-1).cast("long")), "others": F.array_join("others", ",")})


PEOPLE = """faces AS (SELECT o_orderpriority AS season, l_orderkey AS clip, l_orderkey * 8 + l_linenumber AS face_id, CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey % 9 END AS character_id, l_discount AS probability, l_quantity AS height FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def people_of(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("season"))
    who = F.col("l_suppkey") % 9
    return table(spark, sf, "lineitem").join(o, "l_orderkey").select(
        "season", F.col("l_orderkey").alias("clip"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("face_id"), F.when(who > 0, who).alias("character_id"), F.col("l_discount").alias("probability"), F.col("l_quantity").alias("height")
    )


@query(
    "character_overview",
    f"""WITH {PEOPLE}, c AS (SELECT season, unnest(range(1, 11)) AS character_id FROM (SELECT DISTINCT season FROM faces))
SELECT c.season, c.character_id, count(DISTINCT clip) AS clips, count(f.character_id) AS faces, coalesce(round(CAST(sum(CAST(round(probability * 100, 0) AS BIGINT)) AS BIGINT) / count(f.character_id), 4), -1.0) AS mean FROM c LEFT JOIN faces f ON f.season = c.season AND f.character_id = c.character_id GROUP BY ALL""",
)
def character_overview(spark, sf):
    """Ten characters a season, of whom two are never seen; probabilities in hundredths, so that sums are exact."""
    faces = people_of(spark, sf).withColumn("probability", F.round(F.col("probability") * 100).cast("long"))
    cast = faces.select("season").distinct().select("season", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("character_id")).withColumns({"name": F.lit(""), "role": F.lit("MAIN")})
    return people.overview(cast, faces, "season").drop("name", "role").withColumn("mean", F.coalesce(F.round("mean", 4), F.lit(-1.0)))


@query(
    "character_sheet",
    f"""WITH {PEOPLE}, o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY season, character_id) AS n FROM faces WINDOW w AS (PARTITION BY season, character_id ORDER BY CASE WHEN character_id IS NULL THEN -height ELSE -probability END, face_id)),
s AS (SELECT * FROM o WHERE CASE WHEN character_id IS NULL THEN i < 12 ELSE n <= 12 OR list_contains([CAST(round_even(k * (n - 1) / 11, 0) AS BIGINT) FOR k IN range(0, 12)], i) END)
SELECT season, coalesce(character_id, 0) AS character_id, face_id, row_number() OVER (PARTITION BY season, character_id ORDER BY i) - 1 AS place FROM s""",
)
def character_sheet(spark, sf):
    s = people.sheet(people_of(spark, sf), "season", 12)
    return s.select("season", F.coalesce("character_id", F.lit(0).cast("long")).alias("character_id"), "face_id", "place")


@query(
    "skip_times",
    """WITH r AS (SELECT l_orderkey, l_linenumber, ['op', 'ed', 'intro'][l_suppkey % 3 + 1] AS kind, l_partkey % 60 + 1400 AS length, l_quantity AS start, o_custkey % 60 + 1400 AS duration, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, kind, arg_min(start, (abs(length - duration), l_linenumber, start)) AS start, arg_min(start, (abs(length - duration), l_linenumber, start)) + 90 AS "end" FROM r WHERE o_orderstatus <> 'P' AND kind <> 'intro' AND abs(length - duration) <= 15 GROUP BY ALL""",
)
def skip_times(spark, sf):
    """Every order an episode whose line items are the entries of its payload."""
    kind = F.element_at(F.array(F.lit("op"), F.lit("ed"), F.lit("intro")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    entry = F.struct(F.col("l_linenumber").alias("n"), kind.alias("skipType"), F.struct(F.col("l_quantity").alias("startTime"), (F.col("l_quantity") + 90).alias("endTime")).alias("interval"), (F.col("l_partkey") % 60 + 1400).cast("double").alias("episodeLength"))
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("results"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 60 + 1400).cast("double").alias("duration"), (F.col("o_orderstatus") != "P").alias("found"))
    payload = F.to_json(F.struct("found", "results")).alias("payload")
    return media.skip_times(items.join(o, "l_orderkey").select("l_orderkey", "duration", payload), "l_orderkey", "payload", "duration")


@query("episode_list", "SELECT o_custkey, CAST(o_orderkey % 7 AS INT) AS number, arg_max(o_orderstatus, o_orderkey) AS title, arg_max(o_orderpriority, o_orderkey) = '5-LOW' AS filler, false AS recap FROM orders GROUP BY ALL")
def episode_list(spark, sf):
    """Every order a page of one episode of its customer's series; later orders are later pages."""
    row = F.struct((F.col("o_orderkey") % 7).alias("mal_id"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderpriority") == "5-LOW", True).alias("filler"))
    pages = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_json(F.struct(F.array(row).alias("data"))).alias("payload"))
    return media.episode_list(pages, "o_custkey", "o_orderkey", "payload")


#: What measures mean 0 and 1, how they weigh, and where each mood lies (arousal, valence).
MEASURES = {"tempo": (60, 180), "onsets": (1.0, 7.0), "percussive": (0.1, 0.5), "brightness": (800, 3000), "loudness": (-22, -8)}
AROUSAL = {"tempo": 0.15, "onsets": 0.3, "percussive": 0.3, "brightness": 0.15, "loudness": 0.1}
VALENCE = {"major": 0.6, "brightness": 0.25, "tempo": 0.15}
PLACES = {"action": (0.85, 0.4), "funny": (0.7, 0.85), "romance": (0.35, 0.65), "calm": (0.15, 0.55), "sad": (0.2, 0.15)}
MEASURED = {"tempo": "(p_size * 5)", "onsets": "(p_size % 9)", "percussive": "(p_partkey % 7 / 10)", "brightness": "(p_retailprice * 1.5)", "loudness": "(p_partkey % 20 - 25)", "major": "(p_partkey % 5 / 4)"}


def _weighed(weights: dict[str, float]) -> str:
    unit = lambda k: f"least(1.0, greatest(0.0, ({MEASURED[k]}::DOUBLE - {MEASURES[k][0]}) / {MEASURES[k][1] - MEASURES[k][0]}::DOUBLE))" if k in MEASURES else f"{MEASURED[k]}::DOUBLE"
    return f"round(({' + '.join(f'{unit(k)} * {w}::DOUBLE' for k, w in weights.items())}) / {sum(weights.values())!r}::DOUBLE, 3)"


@query(
    "song_feature_moods",
    f"""WITH m AS (SELECT p_partkey, {_weighed(AROUSAL)} AS arousal, {_weighed(VALENCE)} AS valence FROM part)
SELECT *, {', '.join(f"round(exp(-((arousal - {a}::DOUBLE) * (arousal - {a}::DOUBLE) + (valence - {v}::DOUBLE) * (valence - {v}::DOUBLE)) / {2 * 0.3 * 0.3!r}::DOUBLE), 3) AS {k}" for k, (a, v) in PLACES.items())},
  CASE WHEN arousal < 0.35 THEN 'calm' WHEN arousal > 0.65 THEN 'energetic' ELSE 'medium tempo' END || ', ' || CASE WHEN valence < 0.4 THEN 'rather sad' WHEN valence > 0.6 THEN 'rather happy' ELSE 'neutral' END AS description FROM m""",
)
def song_feature_moods(spark, sf):
    """Every part a song with measures of its columns."""
    p = table(spark, sf, "part").select("p_partkey", *[F.expr(f"cast({e} as double)").alias(k) for k, e in MEASURED.items()])
    p = p.select("p_partkey", music.scaled_mean(AROUSAL, MEASURES).alias("arousal"), music.scaled_mean(VALENCE, MEASURES).alias("valence"))
    a, v = F.col("arousal"), F.col("valence")
    return p.select("*", *[music.place_fit(a, v, at, 0.3).alias(k) for k, at in PLACES.items()], music.describe(a, v).alias("description"))
