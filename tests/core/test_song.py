"""Slots, zones and mean energy of songs on small ones worked out by hand; times in milliseconds."""

import pytest
from pyspark.sql import functions as F
from tessella.operators import song

RULES = song.CutRules(shortest=180)


def make(spark, beat=500, drops=(64,)):
    """160 beats: intro to bar 8, verse to 16, chorus to 32, outro to 40; ``drops`` in beats. Energy ten times a second."""
    bar, level = 4 * beat, [(8, 10), (8, 50), (16, 95), (8, 20)]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    curve, at = [], 0
    for bars, v in level:
        curve += [(1, at + k, v) for k in range(bars * bar // 100)]
        at += bars * bar // 100
    return {
        "songs": frame([(1, beat, 160 * beat)], "axis long, beat long, duration long"),
        "beats": frame([(1, i, i * beat) for i in range(160)], "axis long, i long, t long"),
        "downbeats": frame([(1, i * bar) for i in range(40)], "axis long, d long"),
        "sections": frame([(1, 0, 8 * bar, "intro"), (1, 8 * bar, 16 * bar, "verse"), (1, 16 * bar, 32 * bar, "chorus"), (1, 32 * bar, 40 * bar, "outro")], "axis long, start long, end long, label string"),
        "drops": frame([(1, d * beat, 0.5) for d in drops], "axis long, time long, strength double"),
        "sums": song.prefix_sums(frame(curve, "axis long, i long, value long"), "axis"),
    }


def slots(spark, s, start, length, rules=RULES):
    z = song.zones_per_beat(s["beats"], s["songs"], s["sections"], s["drops"], "axis", rules)
    starts = spark.createDataFrame([(1, start)], "axis long, song_start long")
    return song.song_slots(z, s["songs"], s["downbeats"], s["sums"], starts, "axis", length, rules, 100, 250).orderBy("slot_no").collect()


def test_zones_of_beats(spark):
    s = make(spark)
    z = {r.i: (r.label, r.rate) for r in song.zones_per_beat(s["beats"], s["songs"], s["sections"], s["drops"], "axis", RULES).collect()}
    want = {0: ("intro", 4), 40: ("verse", 2), 48: ("buildup", 4), 63: ("buildup", 1), 64: ("drop", 0.5), 79: ("drop", 0.5), 80: ("chorus", 1), 130: ("outro", 4), 159: ("outro", 4)}
    assert {i: z[i] for i in want} == want and len(z) == 160


def test_earlier_drops_and_ends_of_sections_bound_windows(spark):
    """Drops at 60, 70 and 126: the second begins inside the first and gets no build-up; the third ends with its section."""
    s = make(spark, drops=(60, 70, 126))
    w = {(r.start // 500, r.end // 500, r.kind) for r in song.drop_windows(s["drops"], s["sections"], s["songs"], "axis", RULES).collect()}
    assert w == {(44, 60, "buildup"), (60, 64, "drop"), (64, 70, "buildup"), (70, 86, "drop"), (110, 126, "buildup"), (126, 128, "drop")}


def test_slots_cover_the_edit_and_follow_the_zones(spark):
    got = slots(spark, make(spark), 16_000, 22_000)
    assert got[0].start == 0 and got[-1].end == 22_000 and all(a.end == b.start for a, b in zip(got, got[1:]))
    sizes = {}
    for r in got:
        sizes.setdefault(r.section, []).append(r.end - r.start)
    assert set(sizes["verse"]) == {1000} and sizes["buildup"] == [2000, 1000, 1000, 1000, 1000, 500, 500, 500, 500]
    assert set(sizes["drop"][:-1]) == {250} and next(r.start for r in got if r.section == "drop") == 16_000
    assert min(r.intensity for r in got if r.section == "drop") > max(r.intensity for r in got if r.section == "verse")
    assert [r.section for r in sorted(song.slot_summary(spark.createDataFrame(got), "axis").collect(), key=lambda r: r.first)] == ["verse", "buildup", "drop"]


def test_hits_are_the_cut_then_downbeats_then_beats(spark):
    got = slots(spark, make(spark, drops=()), 0, 16_000)
    assert got[0].hits == [0, 500, 1000, 1500] and all(r.hits[0] == 0 for r in got)
    shifted = slots(spark, make(spark, drops=()), 1_000, 6_000)
    assert shifted[0].hits == [0, 1000, 500, 1500]  # the downbeat at 2 s first


def test_half_beats_too_short_become_beats(spark):
    s = make(spark, beat=300)
    got = slots(spark, s, 64 * 300 - 3000, 6000)
    assert min(r.end - r.start for r in got if r.section == "drop") == 300


@pytest.mark.parametrize("drops, length, want", [((64,), 30_000, 20_000), ((), 10_000, 28_000)])
def test_edit_starts_before_the_drop_or_the_chorus(spark, drops, length, want):
    s = make(spark, drops=drops)
    r = song.edit_starts(s["songs"], s["beats"], s["downbeats"], s["sections"], s["drops"], "axis", length).collect()
    assert [x.song_start for x in r] == [want]
    assert song.edit_starts(s["songs"], s["beats"], s["downbeats"], s["sections"], s["drops"], "axis", 100_000).count() == 0


def test_mean_energy_of_any_interval(spark):
    curve = spark.createDataFrame([("a", i, 20 if i < 100 else 80) for i in range(200)] + [("b", 0, 7)], "axis string, i long, value long")
    rows = spark.createDataFrame([("a", 5000, 15000, 50.0), ("a", 0, 0, 20.0), ("a", 99_999, 100_000, 80.0), ("a", -50, 50, 20.0), ("b", 0, 900, 7.0), ("c", 0, 1, 0.0)], "axis string, s long, e long, want double")
    got = song.mean_between(rows, song.prefix_sums(curve, "axis"), "axis", "s", "e", 100)
    assert got.where("mean <> want or mean is null").count() == 0 and got.count() == 6
    sections = spark.createDataFrame([("a", -10, 10_000, "x"), ("a", 15_000, 90_000, "y"), ("a", 30_000, 40_000, "z")], "axis string, start long, end long, label string")
    songs = spark.createDataFrame([("a", 20_000)], "axis string, duration long")
    out = song.sections_with_energy(sections, songs, song.prefix_sums(curve, "axis"), "axis", 100)
    assert sorted(tuple(r) for r in out.select("label", "start", "end", "energy").collect()) == [("x", 0, 10_000, 20.0), ("y", 15_000, 20_000, 80.0)]


def test_walk_meets_what_steps_meet(spark):
    steps = spark.createDataFrame([(a, i, i + 1 + (i * 7 + a) % 5) for a in range(3) for i in range(200)], "axis int, node long, next long")
    starts = spark.createDataFrame([(0, 3), (1, 150), (2, 999)], "axis int, node long")
    want = set()
    for a, at in ((0, 3), (1, 150), (2, 999)):
        while True:
            want.add((a, at))
            if at >= 200:
                break
            at += 1 + (at * 7 + a) % 5
    got = [tuple(r) for r in song.walk(steps, starts, "axis").collect()]
    assert set(got) == want and len(got) == len(want)


def test_no_songs(spark):
    s = make(spark)
    none = {k: v.where(F.lit(False)) for k, v in s.items()}
    z = song.zones_per_beat(none["beats"], none["songs"], none["sections"], none["drops"], "axis", RULES)
    assert z.count() == 0 and slots(spark, none, 0, 1000) == []
