"""Transitions and effects by rules on a few slots; subtitles and labels that were read wrong."""

import pytest
from pyspark.sql import functions as F
from tessella.functions import names
from tessella.operators import effects as fx
from tessella.sources import readers

KINDS = "axis int, slot_no int, start double, end double, section string, hits array<double>, aligned boolean, peak double"


def slots(spark, *parts):
    return spark.createDataFrame([(1, i, float(a), float(b), zone, [0.0, 0.5, 1.0, 1.5], True, 1.0) for i, (a, b, zone) in enumerate(parts)], KINDS)


def bars(spark, *at):
    return spark.createDataFrame([(1, float(d)) for d in at], "axis int, d double")


def into(spark, parts, rules, at=(0, 2, 4, 6), **kw):
    got = fx.transitions(slots(spark, *parts), bars(spark, *at), "axis", rules, 0.5, 24, **kw).orderBy("slot_no").collect()
    assert all((a.out_kind, a.out_length) == (b.kind, b.length) for a, b in zip(got, got[1:])) and got[-1].out_kind == "cut"
    return [(r.kind, r.length) for r in got]


def test_the_first_rule_that_is_set_holds(spark):
    rules = fx.Transitions("cut", downbeat="flash", section="whip", drop="dip_white")
    pick = lambda r, *x: spark.range(1).select(r.pick(*map(F.lit, x))).first()[0]
    assert [pick(rules, *x) for x in ((True, True, True), (False, True, True), (False, False, True), (False, False, False))] == ["dip_white", "whip", "flash", "cut"]
    assert pick(fx.Transitions("crossfade"), True, True, True) == "crossfade"


def test_blends_last_some_beats_or_half_of_a_short_slot(spark):
    parts = [(0, 2, "verse"), (2, 4, "verse"), (4, 6, "chorus"), (6, 6.25, "chorus"), (6.25, 8, "drop")]
    assert into(spark, parts, fx.Transitions("crossfade", section="dip_white", beats=0.75)) == [("cut", 0), ("crossfade", 4), ("dip_white", 4), ("crossfade", 1), ("dip_white", 1)]


def test_flashes_on_downbeats_and_whips_between_zones(spark):
    parts = [(0, 1, "verse"), (1, 2, "verse"), (2, 3, "verse"), (3, 4, "buildup"), (4, 4.25, "drop"), (4.25, 4.5, "drop")]
    got = into(spark, parts, fx.Transitions("cut", downbeat="flash", section="whip", drop="flash"), flash=0.16)
    assert got == [("cut", 0), ("cut", 0), ("flash", 4), ("whip", 2), ("flash", 3), ("cut", 0)]
    assert into(spark, [(0, 1, "a"), (1, 1.1, "b")], fx.Transitions(section="flash")) == [("cut", 0), ("cut", 0)]


def test_ramps_before_slow_motion_and_late_hits_for_freezes(spark):
    parts = [(0, 1, "verse"), (1, 2, "drop"), (2, 2.3, "verse"), (3, 6, "drop")]
    got = fx.prepare(slots(spark, *parts), fx.Rule(("verse",), 0.5, (0.5, 1.6, 0.4)), fx.Rule((), 2.0, (0.8,)), fx.Rule(("drop",), 1.5)).orderBy("slot_no").collect()
    assert [[tuple(p) for p in r.pieces] for r in got] == [[(0.4, 0.5), (1.0, 1.6)], [], [], [(3.0, 0.8)]]
    assert [r.hits for r in got][2:] == [[0.0, 0.5, 1.0, 1.5], [1.5, 1.0, 0.0, 0.5]]


@pytest.mark.parametrize("at, want", [("cut", [0.0]), ("beats", [0.0, 0.5, 1.0, 1.5]), ("downbeats", [0.1, 2.0])])
def test_effects_where_rules_apply(spark, at, want):
    s = fx.prepare(slots(spark, (4, 8, "drop"), (8, 10, "verse")), slowmo=fx.Rule(("verse",), 0, (0.5,)))
    got = fx.effects(s, bars(spark, 1, 4.1, 6, 7.9, 9), "axis", 0.5, fx.Rule(("drop",), 0, (0.12,), at), fx.Rule(("drop",), 0, (0.02,)), fx.Rule((), 3.0, (0.06,)), fx.Rule((), 0.0)).orderBy("slot_no").collect()
    drop, verse = got
    assert drop.punches == want and (drop.shake, drop.push_in, drop.freeze_at) == (0.02, 0.06, 1.0) and verse.punches == []
    assert drop.labels == [f"zoom_punch x{len(want)}", "shake", "push_in", "freeze"] and verse.labels == ["tempo 0.5x"]  # its peak comes at the end


def test_freezes_need_an_aligned_peak_inside(spark):
    s = slots(spark, (0, 4, "a"))
    at = lambda **c: fx.effects(fx.prepare(s.withColumns({k: F.lit(v) for k, v in c.items()})), bars(spark), "axis", 0.5, freeze=fx.Rule()).first().freeze_at
    assert [at(peak=2.0), at(peak=0.1), at(peak=3.9), at(aligned=False)] == [2.0, None, None, None]


def test_subtitle_marks_without_hours(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.500 --> 00:02.000\nShort mark\n\n01:00:03.250 --> 01:00:04.000\nLong mark\n")
    got = [(r.start, r.end, r.text) for r in readers.subtitles(spark, str(tmp_path / "a.vtt")).orderBy("start").collect()]
    assert got == [(1.5, 2.0, "Short mark"), (3603.25, 3604.0, "Long mark")]


def test_all_remarks_of_a_title_go(spark):
    one = lambda t: spark.range(1).select(names.song_title(F.lit(t))).first()[0]
    assert one("Song (Official Video) [HD] official audio (Lyric Video) official video mv") == "Song" and one("My Audiobook") == "My Audiobook" and one("Paudio") == "Paudio"
    # Without brackets only remarks that name a video or its audio go.
    assert one("Song 4K lyrics audio") == "Song 4K lyrics audio"
