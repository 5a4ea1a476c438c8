"""Libraries and their runs, loudness of clips, faults by prompts, starts, choices, moods and plans of edits: exact values, nulls, ties and empty tables."""

import json
import math

import pytest
from pyspark.sql import functions as F
from tessella.operators import boxes, clips, edits, fusion, library, series, vectors
from tessella.plans import editing  # noqa: F401
from tessella.plans import queries as plans

TRACK = "library string, path string, title string, artist string, album string, genres array<string>, duration double, size long, mtime long, tagged boolean, source_id string"
KNOWN = "path string, title string, artist string, album string, genres array<string>, duration double, size long, mtime long, source_id string, analysis string, mood string"


def track(path, title=None, size=1, mtime=1, tagged=None, library="l", genres=None, duration=None, source_id=None, artist=None):
    return (library, path, title, artist, None, genres, duration, size, mtime, tagged, source_id)


def song(path, title="known", size=1, mtime=1, analysis="a", mood="m", source_id=None):
    return (path, title, "artist", "album", ["pop"], 200.0, size, mtime, source_id, analysis, mood)


def db(values, full=1.0):
    return round(max(-100.0, 20 * math.log10(math.sqrt(sum(v * v for v in values) / len(values)) / full + 1e-10)), 2)


def test_loudness_over_blocks(spark):
    samples = [0, 3, -4, 12, 5, 0, 0, 100, -100, 7]
    blocks = [("a", k, samples[4 * k : 4 * k + 4]) for k in range(3)] + [("silent", 0, [0, 0, 0])]
    audio = spark.createDataFrame(blocks, "axis string, block int, samples array<int>")
    asked = [(0.0, 5.0), (0.5, 1.0), (1.5, 4.5), (2.0, 4.0), (4.9, 99.0), (3.0, 3.0), (7.0, 9.0), (0.2, 0.4)]
    rows = [("a", i, *x) for i, x in enumerate(asked)] + [("silent", 0, 0.0, 1.0), ("none", 0, 0.0, 1.0), ("a", 90, None, 1.0)]
    got = {(r.axis, r.clip): r.loudness for r in clips.clip_audio(spark.createDataFrame(rows, "axis string, clip int, start double, end double"), audio, "axis", "clip", 2, 4).collect()}
    assert len(got) == len(rows)
    for i, (a, b) in enumerate(asked):
        inside = samples[int(a * 2) : int(b * 2)]
        assert got["a", i] == (db(inside) if inside else -100.0), i
    assert got["silent", 0] == -100.0 and got["none", 0] is None


def test_loudness_of_no_audio_and_no_clips(spark):
    audio = spark.createDataFrame([], "axis string, block int, samples array<int>")
    one = spark.createDataFrame([("a", 0, 0.0, 1.0)], "axis string, clip int, start double, end double")
    assert [r.loudness for r in clips.clip_audio(one, audio, "axis", "clip", 2, 4).collect()] == [None]
    assert clips.clip_audio(one.where("false"), audio, "axis", "clip", 2, 4).count() == 0


def test_usable_scenes(spark):
    scenes = spark.createDataFrame([(0.0, 10.0, 100.0), (8.0, 20.0, 100.0), (85.0, 95.0, 100.0), (95.0, 100.0, 100.0), (10.0, 90.0, 100.0)], "start double, end double, duration double")
    got = sorted((r.start, r.end) for r in clips.usable(scenes, F.lit(10.0), F.lit(10.0)).collect())
    assert got == [(10.0, 20.0), (10.0, 90.0), (85.0, 90.0)]


def test_largest_faces(spark):
    faces = [(1, i, 0.0, 0.0, w, h) for i, (w, h) in enumerate([(0.1, 0.5), (0.5, 0.1), (0.3, 0.3), (0.0, 0.9), (0.1, 0.4)])] + [(2, 9, 0.0, 0.0, 0.2, 0.01)]
    df = spark.createDataFrame(faces, "frame int, id int, x0 double, y0 double, x1 double, y1 double")
    got = boxes.keep_largest(df, ["frame"], 0.05, 3, "id").select("frame", "id").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (1, 2)]


@pytest.mark.parametrize(
    "stats, prompts, want",
    [
        ((0.5, 0.5, 0.2, 100.0), (0.0, 0.0), (1.0, None)), ((0.5, 0.5, 0.2, 100.0), (0.7, 0.2), (0.0, "text")), ((0.5, 0.5, 0.2, 100.0), (0.5, 0.5), (0.0, "text")), ((0.5, 0.5, 0.2, 100.0), (0.2, 0.6), (0.0, "unsharp")),
        ((0.0, 0.01, 0.2, 100.0), (0.9, 0.9), (0.0, "dark")), ((0.5, 0.5, 0.2, 1.0), (0.1, 0.1), (0.2, "blurry")), ((0.5, 0.5, 0.2, 1.0), (0.6, 0.1), (0.0, "text")), ((0.5, 0.5, 0.2, 100.0), (0.1, 0.1), (0.8, None)),
        ((0.5, 0.5, 0.2, 100.0), (0.45, 0.45), (0.5, None)), ((None, None, None, None), (None, 0.1), (0.9, None)), ((None, None, None, None), (None, None), (1.0, None)), ((None, None, None, None), (None, 0.5), (0.0, "unsharp")),
    ],
)
def test_quality_with_prompts(spark, stats, prompts, want):
    df = spark.createDataFrame([(*stats, *prompts)], "dark double, bright double, contrast double, sharp double, text double, unsharp double")
    q = fusion.quality(F.col("bright"), F.col("bright"), F.col("contrast"), F.col("sharp"), F.lit(100.0), {"text": F.col("text"), "unsharp": F.col("unsharp")})
    got = df.select(q.alias("q")).first().q
    assert (got.score, got.issue) == want


def test_downbeats_of_two_signals(spark):
    """Each signal alone points elsewhere; a flat one counts nothing."""
    rows = [(i, float(i % 4 == 2) * 10 + float(i % 4 == 1) * 8, 1000.0 * (i % 4 == 1), 5.0) for i in range(16)]
    df = spark.createDataFrame(rows, "i int, a double, b double, flat double").withColumn("song", F.lit(1))
    phase = lambda v: series.downbeat_phase(df, ["song"], "i", v).first().phase
    assert (phase("a"), phase(["a", "b"]), phase(["a", "flat"]), phase(["flat", "flat"])) == (2, 1, 2, 0)


def test_zero_shot_over_windows(spark):
    sims = [(0, w, g, p, s) for w in (0, 1) for g, p, s in [("x", 1, 1.0 if w == 0 else 0.0), ("x", 2, 0.0), ("y", 3, 0.0)]] + [(1, 7, "x", 1, 0.0), (1, 7, "x", 2, 0.0), (1, 7, "y", 3, 0.0)]
    df = spark.createDataFrame(sims, "song int, w int, g string, prompt long, sim double")
    got = {(r.song, r.g): (r.p, r.mood, r.top) for r in vectors.zero_shot_windows(df, "song", "w", "g", "prompt", 2.0).collect()}
    e = math.exp(2.0)
    p = [(e / (e + 2) + 1 / 3) / 2, (1 / (e + 2) + 1 / 3) / 2, (1 / (e + 2) + 1 / 3) / 2]
    x, y = (p[0] + p[1]) / 2, p[2]
    assert got[0, "x"] == (round(x / (x + y), 4), round(min(1.0, x / (x + y)), 3), 1) and got[0, "y"] == (round(y / (x + y), 4), round(y / (x + y), 3), 1)
    assert got[1, "x"] == got[1, "y"] == (0.5, 0.5, 1)


def test_song_starts(spark):
    beats = spark.createDataFrame([(1, t) for t in (2.0, 4.0, 6.0, 8.0)], "song int, t double")
    asked = [(1, 0, 10.0, 4.0, None), (1, 1, 10.0, 4.0, 5.0), (1, 2, 10.0, 4.0, 9.9), (1, 3, 10.0, 9.0, None), (1, 4, 10.0, 11.0, None), (2, 5, 10.0, 4.0, 3.0), (2, 6, 3.0, 4.0, None)]
    requests = spark.createDataFrame(asked, "song int, request int, duration double, length double, wanted double")
    got = {r.request: (r.start, r.status) for r in edits.song_starts(requests, beats, "song", "request").collect()}
    assert got == {0: (2.0, "ok"), 1: (4.0, "ok"), 2: (6.0, "ok"), 3: (0.0, "ok"), 4: (None, "too short"), 5: (None, "no beats"), 6: (None, "no beats")}


def test_choices_cost_what_was_used_before(spark):
    """The mean after 26 choices of 13 episodes is 2: two more of one episode cost a third each."""
    before = [e for e in range(2, 14) for _ in range(2)]
    for own, want in [(2, 0.0), (3, 0.333), (4, 0.667), (5, 1.0), (6, 1.0)]:
        taken = [1] * own + before[: 26 - own] + [1]
        df = spark.createDataFrame([(0, i, e, 13) for i, e in enumerate(taken)], "edit int, slot int, episode int, episodes int")
        last = edits.choices(df, "edit", "slot").where("slot = 26").first()
        assert last.overuse == want, own
    rows = [(0, 0, 1), (0, 1, 1), (0, 2, None), (0, 3, 1), (0, 4, None), (0, 5, 2), (1, 0, 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "edit int, slot int, episode int, episodes int")
    got = [(r.repeat, r.overuse) for r in edits.choices(df, "edit", "slot", 2).orderBy("edit", "slot").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.5, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_scores_and_characters(spark):
    df = spark.createDataFrame([(None, {1: 0.5, 2: 1.0}), (1.0, None)], "mood double, found map<bigint,double>").withColumn("character", edits.character_match(F.col("found"), (1, 3))).withColumn("repeat", F.lit(0.5))
    assert [r.score for r in edits.scored(df, {"mood": 1.0, "character": 2.0, "repeat": 0.4}).collect()] == [0.8, 0.8]
    assert [r.c for r in df.select(edits.character_match(F.col("found"), ()).alias("c")).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        edits.scored(df, {"look": 1.0})


def test_edit_moods_and_fit(spark):
    clip = spark.createDataFrame([(1, 0.8, 0.2), (1, 0.4, 0.4), (1, None, None), (2, None, 0.9)], "edit int, action double, calm double").withColumn("season", F.lit("s"))
    got = {(r.edit, r.mood): (r.average, r.strongest) for r in edits.edit_moods(clip, ["edit"], ["action", "calm"]).collect()}
    assert got == {(1, "action"): (0.6, 2), (1, "calm"): (0.3, 0), (2, "action"): (0.0, 0), (2, "calm"): (0.9, 1)}
    fit = {r.edit: (r.in_edit, r.in_season) for r in edits.style_fit(clip, clip, ["season", "edit"], "season", {"action": 1.0}).collect()}
    assert fit == {1: (0.6, 0.6)}


def test_plans_are_whole_json(spark):
    made = spark.createDataFrame([(1, "hype"), (2, None)], "edit int, style string")
    clip = spark.createDataFrame([(1, 2, "é\"", None), (1, 1, "a", 0.5), (3, 1, "lost", 1.0)], "edit int, slot int, video string, score double")
    got = {r.edit: json.loads(r.plan) for r in edits.plans(made, clip, "edit", "slot").collect()}
    assert got == {
        1: {"edit": 1, "style": "hype", "clips": [{"slot": 1, "video": "a", "score": 0.5}, {"slot": 2, "video": "é\"", "score": None}]},
        2: {"edit": 2, "style": None, "clips": []},
    }
    assert edits.plans(made, clip.where("false"), "edit", "slot").count() == 2


def test_tags_of_unchanged_files(spark):
    t = spark.createDataFrame([track("a"), track("b", size=2), track("c", "own", tagged=True), track("d"), track("e"), track(None)], TRACK)
    k = spark.createDataFrame([song("a"), song("b"), song("c"), song("d", title=None)], KNOWN)
    got = {r.path: (r.title, r.album, r.duration, r.tagged) for r in library.fill_tags(t, k).collect()}
    none = (None, None, None, False)
    assert got == {"a": ("known", "album", 200.0, True), "b": none, "c": ("own", None, None, True), "d": none, "e": none, None: none}


def test_search_and_genre(spark):
    t = spark.createDataFrame([track("/x/One.mp3", "Song", artist="Ann", genres=["J-Pop", None]), track("/one/two.mp3", genres=[]), track(None, "one")], TRACK)
    hits = lambda *a: [r.hit for r in t.select(library.matches(*a).alias("hit")).collect()]
    assert hits("ONE") == [True, False, True] and hits("ann song") == [True, False, False]
    assert hits(None, "pop") == [True, False, False] and hits("two", "pop") == [False, False, False] and hits() == [True, True, True]


def test_run_of_a_library(spark):
    t = [track("a", "t"), track("b", "t"), track("c", "other"), track("d", duration=10.0), track("e", "skip"), track("f"), track("g"), track("h"), track("i", "t", source_id="s"), track("j", library="m"), track("k", duration=None, size=5)]
    tracks = spark.createDataFrame(t, TRACK)
    known = spark.createDataFrame([song("a", "t"), song("c", "t"), song("f", mood=None), song("i", "t"), song("k", size=4)], KNOWN)
    failed = spark.createDataFrame([("b", 1, 1), ("b", 1, 1), ("g", 1, 0), ("a", 2, 1)], "path string, size long, mtime long")
    run = lambda **s: {r.path: (r.status, r.retag) for r in library.plan_run(tracks, known, failed, "library", F.coalesce(F.col("title") != "skip", F.lit(True)), **s).collect()}
    want = {
        "a": ("known", False), "b": ("failed_before", False), "c": ("known", True), "d": ("wrong_length", False), "e": ("filtered", False), "f": ("todo", False), "g": ("todo", False),
        "h": ("todo", False), "i": ("known", True), "j": ("todo", False), "k": ("todo", False),
    }
    assert run() == want
    assert run(limit=2) == {**want, "h": ("pending", False), "k": ("pending", False)}
    assert {p for p, (s, _) in run(force=True).items() if s == "todo"} == set("abcfghijk")
    report = {r.library: r.asDict() for r in library.report(library.plan_run(tracks, known, failed, "library", F.lit(True), limit=2), "library").collect()}
    assert report["l"] == {"library": "l", "found": 10, "failed_before": 1, "filtered": 0, "wrong_length": 1, "known": 3, "todo": 2, "pending": 3, "retag": 2}
    assert library.plan_run(tracks.where("false"), known, failed, "library", F.lit(True), limit=2).count() == 0


def test_merged_songs_keep_what_a_run_lacks(spark):
    known = spark.createDataFrame([("a", "old", "x"), ("b", "old", "y")], "path string, title string, mood string")
    done = spark.createDataFrame([("a", None), ("c", "new")], "path string, title string")
    once = library.merge_songs(known, done)
    assert sorted(map(tuple, once.collect())) == [("a", None, "x"), ("b", "old", "y"), ("c", "new", None)]
    assert sorted(map(tuple, library.merge_songs(once, done).collect())) == sorted(map(tuple, once.collect()))


def test_usable_songs(spark):
    rows = [
        ("l", "/long/a", None, "folder", "m", "a", 5, "h", ["model"]), ("l", "/b", "t", None, "m", "a", 5, "h", ["model"]), ("l", "/c", None, None, "m", "a", 5, "h", None), ("l", "/d", "t", None, "m", "a", 5, "other", ["measures"]),
        ("l", "/e", "t", None, None, "a", 5, "h", None), ("l", "/f", "t", None, "m", "a", 5, None, None), ("m", "/g", "t", None, "m", None, 5, None, None),
    ]
    df = spark.createDataFrame(rows, "library string, path string, title string, source string, mood string, analysis string, size long, content string, signals array<string>")
    songs, counts = library.usable_songs(df, "library")
    assert sorted(r.path for r in songs.collect()) == ["/d", "/long/a"]
    got = {r.library: r.asDict() for r in counts.collect()}
    assert got["l"] == {"library": "l", "no_mood": 1, "missing": 1, "songs": 2, "copies": 2, "measured_only": 1}
    assert got["m"] == {"library": "m", "no_mood": 1, "missing": 0, "songs": 0, "copies": 0, "measured_only": 0}


def test_queries_meet_every_state(spark, small):
    states = {r.status for r in plans.QUERIES["library_plan"](spark, small).select("status").distinct().collect()}
    assert states >= {"failed_before", "filtered", "wrong_length", "known", "todo"}
