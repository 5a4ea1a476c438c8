"""Shared segments, motion of clips, key frames, media and sequels against plain versions and values worked out by hand."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.operators import clips, matching, media, vectors


def units(draw, n, size=12):
    x = draw.normal(0, 1, (n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, **series):
    rows = [(name, i, [float(x) for x in v]) for name, m in series.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "series string, i long, v array<double>")


def segment(spark, a, b, similarity=0.9, least=200, most=650, gap=10):
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    return [tuple(r) for r in matching.shared_segments(frames(spark, a=a, b=b), pairs, similarity, least, most, gap).collect()]


def test_a_shared_block_at_other_offsets(spark):
    draw = np.random.default_rng(0)
    block = units(draw, 450)
    a = np.concatenate([units(draw, 100), block, units(draw, 300)])
    b = np.concatenate([units(draw, 250), block, units(draw, 100)])
    ((_, _, start_a, start_b, length, coverage),) = segment(spark, a, b)
    assert abs(start_a - 100) <= 2 and start_b - start_a == 150 and abs(length - 450) <= 4 and coverage > 0.95


def test_gaps_are_bridged_and_silence_matches_nothing(spark):
    draw = np.random.default_rng(1)
    block = units(draw, 300)
    other = block.copy()
    other[100:108] = units(draw, 8)
    a = np.concatenate([np.zeros((400, 12)), block])
    b = np.concatenate([other, np.zeros((400, 12))])
    ((_, _, start_a, start_b, length, coverage),) = segment(spark, a, b)
    assert (start_a, start_b, length) == (400, 0, 300) and 0.95 < coverage < 1


def test_nothing_shared_or_too_short(spark):
    draw = np.random.default_rng(2)
    assert segment(spark, units(draw, 400), units(draw, 400)) == []
    jingle = units(draw, 50)
    assert segment(spark, np.concatenate([units(draw, 200), jingle]), np.concatenate([jingle, units(draw, 200)])) == []


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.97])
def test_cells_lose_no_pair(spark, similarity):
    draw = np.random.default_rng(3)
    base = units(draw, 40, 5)
    a, b = (base + draw.normal(0, 0.15, base.shape) for _ in range(2))
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    want = {(i, j) for i, j in zip(*np.nonzero(ua @ ub.T >= similarity))}
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    got = [(r.i, r.j) for r in matching.similar_frames(frames(spark, a=a, b=b), pairs, similarity, 3).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_cells_spare_most_comparisons(spark):
    draw = np.random.default_rng(4)
    f = frames(spark, a=units(draw, 300, 3), b=units(draw, 300, 3))
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = matching.similar_frames(f, pairs, 0.99, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "c2" in plan


def plain_segment(a, b, similarity, least, most, max_gap, coverage):
    """One diagonal after the other; ``a``, ``b``: lists of (index, vector)."""
    alike = lambda v, w: len(v) == len(w) and any(v) and any(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= similarity
    diagonals, best = {}, None
    for i, v in a:
        for j, w in b:
            if alike(v, w):
                diagonals.setdefault(j - i, []).append(i)
    for k, hits in sorted(diagonals.items()):
        runs = []
        for i in sorted(hits):
            if runs and i - runs[-1][1] <= max_gap + 1:
                runs[-1][1:] = [i, runs[-1][2] + 1]
            else:
                runs.append([i, i, 1])
        first, last, n = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
        length = last - first + 1
        if least <= length <= most and n / length >= coverage and (best is None or length > best[2]):
            best = (first, first + k, length, n / length)
    return best


@pytest.mark.parametrize("block", [3, 8, 1000])
def test_segments_of_series_in_blocks_of_any_size(spark, block):
    """Runs over the borders of blocks, silence, missing and repeated indexes, some below zero, vectors of two sizes, pairs without a series."""
    draw, rows, series = random.Random(block), [], {}
    for name in range(12):
        start, size = draw.randrange(-9, 9), draw.randrange(1, 45)
        picked = [start + k for k in range(size) if draw.random() < 0.9] + [start] * (name % 3 == 0)
        series[name] = [(i, [float(draw.random() < 0.5) for _ in range(3 if draw.random() < 0.9 else 4)]) for i in picked]
        rows += [(name, i, v) for i, v in series[name]]
    draw.shuffle(rows)
    pairs = [(a, b) for a in range(13) for b in range(13) if a <= b]
    rules = (0.75, 4, 15, 2, 0.6)
    got = matching.shared_segments(spark.createDataFrame(rows, "series int, i long, v array<double>").repartition(5), spark.createDataFrame(pairs, "a int, b int"), *rules, block=block)
    want = {p: plain_segment(series.get(p[0], []), series.get(p[1], []), *rules) for p in pairs}
    want = {p: s for p, s in want.items() if s}
    assert {(r.a, r.b): (r.start_a, r.start_b, r.length, r.coverage) for r in got.collect()} == want and len(want) > 30


def test_runs_over_several_blocks_are_one(spark):
    """A long gap, wider than the blocks between, is bridged too."""
    a = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 9 + [[1.0, 0.0]] * 30
    f = spark.createDataFrame([(s, i, v if s == "a" else [v[0], 0.0]) for s in "ab" for i, v in enumerate(a)], "series string, i long, v array<double>")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    got = lambda gap, block: [tuple(r)[2:] for r in matching.shared_segments(f, pairs, 0.9, 40, 69, gap, 0.5, block=block).collect()]
    assert got(9, 4) == got(9, 512) == [(0, 0, 69, 60 / 69)] and got(8, 4) == got(8, 512) == []


def test_frames_that_are_no_numbers_match_nothing(spark):
    """Comparisons with NaN are true in Spark."""
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    for x, found in ((float("nan"), 0), (None, 0), (float("inf"), 0), (0.5, 1)):
        f = spark.createDataFrame([(s, i, [1.0, x]) for s in "ab" for i in range(20)], "series string, i long, v array<double>")
        assert matching.shared_segments(f, pairs, 0.9, 3, 20, 0, 0.9).count() == found


def motion(spark, values, start, end, edge=0, smooth=1, step=10):
    curve = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "axis int, i long, value double")
    c = spark.createDataFrame([(1, 7, start, end)], "axis int, clip int, start long, end long")
    return [(r.motion, r.peak) for r in clips.clip_motion(c, curve, "axis", "clip", step, edge, smooth).collect()]


def test_motion_at_the_cut_does_not_count(spark):
    values = [0.0] * 120
    values[24], values[40] = 50.0, 3.0
    assert motion(spark, values, 240, 600, edge=24) == [(round(3 / 31, 4), 400)]
    assert motion(spark, values, 240, 600)[0][1] == 240


def test_short_clips_and_ends_of_curves(spark):
    assert motion(spark, range(120), 300, 330, edge=20, smooth=3) == [(31.5, 320)]  # 30 to 33; the sums are 61, 93, 96 and 65
    assert motion(spark, range(120), 2000, 2100) == []
    assert motion(spark, range(120), 1185, 1500) == [(119.0, 1190)]
    assert motion(spark, [1, 1, 1], 0, 20, smooth=5) == [(1.0, 0)]


@pytest.mark.parametrize("smooth", [1, 2, 3, 4, 5])
def test_smoothing_takes_zero_beyond_the_ends(spark, smooth):
    draw = random.Random(smooth)
    values = [draw.randrange(9) for _ in range(30)]
    full = np.convolve(values, np.ones(smooth))[(smooth - 1) // 2 :][:30]
    assert motion(spark, values, 0, 290, smooth=smooth) == [(round(float(np.mean(values)), 4), int(full.argmax()) * 10)]


def test_key_frames_of_clips(spark):
    c = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 0.0, 1.0), (1, 3, 5.0, 5.3), (1, 4, 0.0, 2.9)], "axis int, clip int, start double, end double")
    plan = clips.plan_frames(c, "axis", "clip", 4.0, 0.25, 2.0, 3)
    got = {(r.clip, r.frame, r.thumbnail) for r in plan.collect()}
    # 0.25 + 9.5 / 6, / 2 and * 5 / 6; one frame; the middle; two frames at 0.85 and 2.05 seconds, the later is the thumbnail
    assert got == {(1, 7, False), (1, 20, True), (1, 33, False), (2, 2, True), (3, 21, True), (4, 3, False), (4, 8, True)}
    owners = {r.frame: [tuple(o) for o in r.owners] for r in clips.frame_owners(plan.unionByName(plan.withColumn("clip", F.col("clip") + 10)), "axis", "clip").collect()}
    assert owners[2] == [(2, True), (12, True)] and len(owners) == 7


def test_media_of_payloads(spark):
    edge = lambda kind, i, type_="ANIME", format_="TV": {"relationType": kind, "node": {"id": i, "type": type_, "format": format_}}
    full = {"id": 5, "idMal": 50, "format": "TV", "title": {"romaji": "Roma", "english": "", "native": None}, "synonyms": ["R", ""], "genres": ["Drama"], "tags": [{"name": "x", "rank": 3}],
            "relations": {"edges": [edge("PREQUEL", 1), edge("SEQUEL", 2, "MANGA"), edge("SEQUEL", 3, format_="MOVIE"), edge("SEQUEL", 4), edge("SEQUEL", 9)]},
            "characters": {"edges": [{"role": "MAIN", "node": {"id": 8, "name": {"full": "A B"}, "image": None}}]}}
    rows = spark.createDataFrame([(json.dumps(full),), (json.dumps({"id": 6, "title": {}}),), ("no json",), (None,)], "p string").select(media.parse_media(F.col("p")).alias("m")).collect()
    a, b, c, d = (r.m for r in rows)
    assert (a.id, a.mal_id, a.title, a.titles, a.sequel_id, a.genres) == (5, 50, "Roma", ["Roma", "R"], 4, ["Drama"]) and a.characters[0].asDict() == {"id": 8, "name": "A B", "role": "MAIN", "image_url": None}
    assert (b.id, b.title, b.titles, b.sequel_id) == (6, "6", [], None) and c is None and d is None


def test_sequels_are_followed_and_circles_end(spark):
    links = {i: i + 1 for i in range(1, 30)} | {100: 101, 101: 100, 200: None}
    df = spark.createDataFrame(list(links.items()), "id long, next long")
    asked = [(1, h) for h in (0, 1, 5, 28, 29, 30, 70)] + [(100, 7), (200, 0), (200, 1), (300, 0)]
    got = {(r.id, r.hops): r.reached for r in media.follow(spark.createDataFrame(asked, "id long, hops long"), df).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 5): 6, (1, 28): 29, (1, 29): 30, (1, 30): None, (1, 70): None, (100, 7): 101, (200, 0): 200, (200, 1): None, (300, 0): 300}


def test_season_of_the_best_match(spark):
    searches = spark.createDataFrame([("x", 3), ("x", 9), ("y", 1), ("z", 1)], "search string, number long")
    found = spark.createDataFrame([("x", 1, 0.9, 1), ("x", 7, 0.9, 0), ("x", 8, 0.8, 2), ("y", 3, 0.7, 0)], "search string, id long, score double, place int")
    links = spark.createDataFrame([(7, 20), (20, 21), (21, None)], "id long, next long")
    assert sorted(map(tuple, media.season_of(searches, found, links).collect())) == [("x", 3, 7, 21), ("x", 9, 7, None)]


def test_more_references_than_fit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_REFERENCES", 2)
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    refs = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "ref int, ref_embedding array<double>")
    assert vectors.similarities(v, refs.where("ref < 2")).count() == 2
    with pytest.raises(ValueError, match="references"):
        vectors.similarities(v, refs)
