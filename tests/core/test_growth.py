"""What has to stay bounded as tables grow: rows travel once, no task holds a group, plans keep the story's order."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import matching, people, planner, ranks, song
from tessella.plans import editing, queries, structure

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_story_keeps_room_for_a_long_slot_to_come():
    """The only clip that is long enough for the last slot stands before others that fit the first."""
    settings = {"seed": 7, "window": 60.0, "crowd": 2, "run": 2, "same_character": 0, "characters": (), "repeat": 6, "energy": 1.0, "w_repeat": 0.3, "w_overuse": 0.3, "top": 1}
    n = 6
    clips = pd.DataFrame({"edit_id": 1, "clip_id": range(n), "episode": 1, "start": [100.0 * k for k in range(n)], "peak": np.nan, "motion_rank": 0.5, "tier": 0, "in_pool": False, "characters": None})
    clips["end"] = clips["start"] + [2.0, 2.0, 9.0, 2.0, 2.0, 2.0]
    clips["static"] = [0.0, 0.1, 0.0, 0.2, 0.9, 0.3]
    slots = pd.DataFrame({"edit_id": 1, "slot_no": [0, 1], "need": [1.0, 8.0], "intensity": 0.5, "hits": [[0.0], [0.0]]})
    got = planner._fold("story", settings)((1,), slots, clips)
    assert got["clip_id"].tolist() == [1, 2]


@pytest.mark.parametrize("seed", range(20))
def test_fullest_spans(seed):
    rng = np.random.default_rng(seed)
    times, at = rng.integers(0, 200, 12).astype(float), rng.integers(0, 200, 30).astype(float)
    assert planner.fullest_spans(times, at, 60.0).tolist() == [planner.fullest_span(times, x, 60.0) for x in at]


def test_clips_of_edits_travel_once(spark):
    """They meet their orders, and then go to their edit; before, they were dealt by range, written, and dealt out again for each window."""
    _, clips = queries.edit_inputs(spark, SF)
    assert plan_of(clips).count("hashpartitioning(edit_id") == 1 and "ranges-" not in plan_of(clips)


def test_medians(spark):
    rows = [(None if k % 5 == 4 else k % 5, None if k % 11 == 0 else float(k * 37 % 101)) for k in range(400)] + [(77, None), (78, 2.0)]
    got = {r.k: r.m for r in ranks.medians(spark.createDataFrame(rows, "k long, v double").repartition(5), ["k"], "v", "m").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: float(np.median(v)) for k, v in groups.items()}


@pytest.mark.parametrize("query", [queries.quality_case, editing.quality_prompts, queries.motion_rank])
def test_no_task_has_a_season(spark, query):
    """Clips are not dealt out by their season, of which there are five."""
    assert "hashpartitioning(season" not in plan_of(query(spark, SF)) and "hashpartitioning(_season_" not in plan_of(query(spark, SF))


@pytest.mark.parametrize("query", [queries.moods_top_pool, queries.season_profile, editing.edit_moods, editing.edit_style_fit])
def test_pools_need_no_ranking_of_all_clips(spark, query, monkeypatch):
    """Only clips as good as the last one that gets in are ranked, by their keys."""
    ranked = []
    monkeypatch.setattr(ranks, "positions", lambda df, *a, f=ranks.positions: ranked.append(df.count()) or f(df, *a))
    query(spark, SF).collect()
    assert len(ranked) == 1 and ranked[0] < 0.05 * spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_top_share_of_ties_and_nulls(spark):
    rows = [(k % 3, None if k % 7 == 0 else (k * 13 % 5) / 2, k) for k in range(300)] + [(9, None, k) for k in range(10)] + [(None, 1.0, k) for k in range(7)]
    got = {(r.k, r.id) for r in ranks.top_share(spark.createDataFrame(rows, "k long, v double, id long").repartition(4), "v", ["id"], ["k"], 0.3).collect()}
    expected = set()
    for g in {k for k, _, _ in rows}:
        own = sorted([(v, i) for k, v, i in rows if k == g], key=lambda x: (x[0] is None, -(x[0] or 0), -x[1]))
        expected |= {(g, i) for _, i in own[: max(1, round(len(own) * 0.3))]}
    assert got == expected


def test_payloads_are_read_once(spark):
    """However many fields are taken, each payload is parsed once, and walks along sequels do not parse at all."""
    plan = plan_of(structure.parse_media(spark, SF))
    assert plan.count("from_json") == 1
    assert "from_json" not in plan_of(structure.season_of(spark, SF))


def test_searches_meet_distinct_names(spark):
    """A thousand characters of one name are compared once, and no season is one task."""
    rows = [("s", k, f"Ann Lee {k % 3}", "MAIN", k) for k in range(1000)]
    characters = spark.createDataFrame(rows, "season string, character_id long, name string, role string, position int")
    asked = spark.createDataFrame([("s", "lee 1"), ("s", "Ann")], "season string, search string")
    found = people.find(asked, characters, "season", "search")
    got = sorted((r.search, r.place, r.character_id) for r in found.collect())
    assert got == [("Ann", i, k) for i, k in enumerate(range(1000))] + [("lee 1", i, k) for i, k in enumerate(range(1, 1000, 3))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(people.find(asked, characters, "season", "search"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(season#\d+, \d+\)", plan)


def test_names_of_all_characters(spark):
    """Every character alone and between letters, as Python's own normalisation has it."""
    codes = [*range(1, 0xD800), *range(0xE000, 0x110000, 7)]
    texts = spark.createDataFrame([(c, f"Ab{chr(c)}Cd {chr(c)}") for c in codes if chr(c) != "\0"], "c int, t string").repartition(8)
    bad = [(hex(r.c), r.n) for r in texts.select("c", "t", text.normalize_name("t").alias("n")).collect() if r.n != text._plain(r.t).strip()]
    assert bad == []


def test_names_stay_out_of_python(spark):
    """Accents and other scripts need no Python; only characters that stand for several do."""
    rows = spark.createDataFrame([("Café Ñandú – Große İI",), ("ﬁre ½",), (None,), ("",)], "t string")
    seen = rows.select(text.normalize_name("t").alias("n")).collect()
    assert [r.n for r in seen] == ["cafe nandu gro e ii", "fire 1 2", None, ""]
    assert rows.where(F.rlike("t", F.lit(text._folded()[2]))).count() == 1


def test_walks_meet_what_a_walk_meets(spark):
    """One pass over each song instead of rounds of joins; a song whose start is no node meets nothing."""
    steps = spark.createDataFrame([(a, n, n + 1 + (a * 7 + n * 5) % 4, float(n)) for a in range(6) for n in range(40) if (a, n) != (5, 3)], "axis long, node long, next long, at double")
    starts = spark.createDataFrame([(a, 3) for a in range(6)], "axis long, node long")
    # ``walk`` also names the place behind the last node.
    by_rounds = {(r.axis, r.node) for r in song.walk(steps, starts, "axis").collect() if r.node < 40}
    got = song.walks(steps, "axis", F.lit(3)).collect()
    assert {(r.axis, r.node) for r in got if r.axis != 5} == {x for x in by_rounds if x[0] != 5} and not [r for r in got if r.axis == 5]
    assert all(r.at == r.node for r in got)


def test_slots_write_no_rounds(spark, monkeypatch):
    """Beats, songs, drops, sums, zones and cuts are written, once each, however long the walk is."""
    names = []
    for module in (song, structure):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: names.append(name) or f(df, name))
    structure.song_slots(spark, SF).count()
    assert sorted(names) == ["beats", "cuts", "song", "song", "songs", "zones"]


def test_segments_deal_out_blocks_and_runs(spark, monkeypatch):
    """No row for each frame of each pair, nor for each hit; before, each frame of a pair went to nine cells, and hits were sorted twice."""
    parts, blocks = [], []
    monkeypatch.setattr(matching, "_joined", lambda df, *a, f=matching._joined: parts.append(df.count()) or f(df, *a))
    monkeypatch.setattr(matching, "_blocks", lambda df, *a, f=matching._blocks: blocks.append(f(df, *a).count()) or f(df, *a))
    plan = plan_of(structure.shared_segments(spark, SF))
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    hits = matching.similar_frames(structure.frames_of(spark, SF), spark.createDataFrame([(a, a + d) for a in range(users) for d in (1, 2, 3)], "a long, b long"), structure.ALIKE).count()
    assert blocks == [users] and parts[0] < 0.05 * hits and "c0" not in plan
