"""Stages of an index: what changes reach, second runs, changed ids and skipped spans."""

from tessella.operators import stages
from tessella.operators.stages import Stage

GRAPH = [Stage("cut", ("size", "source"), "a"), Stage("move", ("cut",)), Stage("talk", ("size",)), Stage("mood", ("move", "talk"), whole=True), Stage("rank", ("mood",))]
EPISODE = "id long, season string, size long, source string"
ROWS = [(1, "x", 10, "s"), (2, "x", 20, "s"), (3, "y", 30, "s"), (4, None, 40, None)]


def stale(spark, now, stored, graph=GRAPH):
    df = stages.advance(spark.createDataFrame(now, EPISODE), stored, "id", "season", graph)
    return {r.id: r.stale for r in df.collect()}


def signed(spark, rows, graph=GRAPH):
    return stages.signatures(spark.createDataFrame(rows, EPISODE), "id", "season", graph)


def test_first_and_second_run(spark):
    names = [s.name for s in GRAPH]
    stored = signed(spark, [])
    first = stages.advance(spark.createDataFrame(ROWS, EPISODE), stored, "id", "season", GRAPH)
    assert {r.id: r.stale for r in first.collect()} == {k: names for k in (1, 2, 3, 4)}
    again = stages.advance(spark.createDataFrame(ROWS, EPISODE), first.drop("stale"), "id", "season", GRAPH)
    assert {r.id: r.stale for r in again.collect()} == {k: [] for k in (1, 2, 3, 4)}
    assert sorted(map(str, again.drop("stale").collect())) == sorted(map(str, first.drop("stale").collect()))


def test_a_change_reaches_what_is_below_it(spark):
    stored = signed(spark, ROWS)
    source = [(1, "x", 10, "t"), *ROWS[1:]]
    assert stale(spark, source, stored) == {1: ["cut", "move", "mood", "rank"], 2: ["mood", "rank"], 3: [], 4: []}
    size = [*ROWS[:2], (3, "y", 31, "s"), ROWS[3]]
    assert stale(spark, size, stored) == {1: [], 2: [], 3: ["cut", "move", "talk", "mood", "rank"], 4: []}
    settings = [*GRAPH[:4], Stage("rank", ("mood",), "new")]
    assert stale(spark, ROWS, stored, settings) == {k: ["rank"] for k in (1, 2, 3, 4)}
    # null seasons are one, and null is a value of its own
    assert stale(spark, [*ROWS[:3], (4, None, 40, "null")], stored)[4] == ["cut", "move", "mood", "rank"]


def test_new_and_gone_episodes(spark):
    stored = signed(spark, ROWS)
    got = stale(spark, [ROWS[0], ROWS[2], ROWS[3], (5, "y", 1, "s")], stored)
    assert got[2] == [] and got[1] == ["mood", "rank"] and got[3] == ["mood", "rank"] and got[5] == [s.name for s in GRAPH] and got[4] == []
    load = stages.workload(stages.advance(spark.createDataFrame([*ROWS, (5, "y", 1, "s")], EPISODE), stored, "id", "season", GRAPH), "season", GRAPH)
    assert {(r.season, r.stage): r.n for r in load.collect()} == {("y", "cut"): 1, ("y", "move"): 1, ("y", "talk"): 1, ("y", "mood"): 1, ("y", "rank"): 2}


def test_swapped_episodes_are_a_change(spark):
    stored = signed(spark, ROWS)
    assert "mood" in stale(spark, [(1, "x", 20, "s"), (2, "x", 10, "s"), *ROWS[2:]], stored)[1]


def test_changed_ids_reset_what_depends_on_them(spark):
    season = "season string, id long"
    before = spark.createDataFrame([("x", 1), ("y", 2), ("z", None), ("w", 4)], season)
    after = spark.createDataFrame([("x", 1), ("y", 3), ("z", 7), ("w", None), ("new", 9)], season)
    rows = [(k, s, 1, "found") for k, s in enumerate(["x", "y", "z", "w", "new", None])]
    e = spark.createDataFrame(rows, EPISODE.replace("id long", "id long"))
    got = {r.season: r.source for r in stages.reset_changed(e, before, after, "season", "id", "source").collect()}
    assert got == {"x": "found", "y": None, "z": "found", "w": None, "new": "found", None: "found"}


def test_skips_are_replaced_for_searched_episodes(spark):
    span = "ep long, kind string, start double, end double, source string"
    known = spark.createDataFrame([(1, "op", 0.0, 90.0, "a"), (2, "op", 1.0, 90.0, "a"), (3, "ed", 5.0, 9.0, "a")], span)
    found = spark.createDataFrame([(1, "op", 2.0, 91.0, "b+a"), (1, "ed", 3.0, 4.0, "b"), (2, None, None, None, None), (4, "op", 1.0, 2.0, "c")], span)
    rows, source = stages.write_skips(known, found, "ep")
    assert sorted((r.ep, r.kind, r.start) for r in rows.collect()) == [(1, "ed", 3.0), (1, "op", 2.0), (3, "ed", 5.0), (4, "op", 1.0)]
    assert {r.ep: r.skips_source for r in source.collect()} == {1: "a+b", 2: "none", 4: "c"}
