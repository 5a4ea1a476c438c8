"""Framings of single shots with known windows, and of random ones against going through the faces one by one."""

import random

import pytest
from pyspark.sql import functions as F
from tessella.operators import framing
from tessella.operators.framing import FrameRules

SHOT = "shot int, start double, end double, duration double, aspect double, motion_x double"
FACE = "shot int, face_id long, time double, x0 double, y0 double, x1 double, y1 double, probability double, wanted boolean"
WIDTH = (9 / 16) / (16 / 9)
PAIR = [(0.1, 0.25, 0.7), (0.7, 0.85, 0.6)]


def frame(spark, faces, rules=FrameRules(), duration=2.0, aspect=16 / 9, motion=None):
    """``faces``: x0, x1, y1 and perhaps time, wanted."""
    rows = [(1, i, (f + (10.5,))[3] if len(f) < 5 else f[3], f[0], 0.2, f[1], f[2], 0.9, len(f) > 4 and f[4]) for i, f in enumerate(faces)]
    shots = spark.createDataFrame([(1, 10.0, 12.0, duration, aspect, motion)], SHOT)
    (r,) = framing.frame_shots(shots, spark.createDataFrame(rows, FACE), ["shot"], rules).collect()
    return r


CASES = [
    ([(0.7, 0.85, 0.6)], {}, "face", [(0, 0.775)], (1, 1, True, 0)),
    ([(0.9, 0.98, 0.6)], {}, "face", [(0, 1 - WIDTH / 2)], (1, 1, True, 0)),
    ([(0.3, 0.42, 0.6), (0.48, 0.6, 0.6)], {}, "face", [(0, 0.45)], (2, 2, True, 1)),
    (PAIR, {}, "pan", [(0.4, 0.175), (1.6, 0.775)], (2, 2, True, 0)),
    (PAIR, {"duration": 1.0}, "main", [(0, 0.175)], (2, 1, True, 0)),
    (PAIR, {"rules": FrameRules(too_wide="fit")}, "fit", [(0, 0.5)], (2, 2, True, 0)),
    (PAIR, {"rules": FrameRules(too_wide="main")}, "main", [(0, 0.175)], (2, 1, True, 0)),
    ([(0.1, 0.25, 0.6, 10.2), (0.7, 0.85, 0.6, 11.6)], {}, "face", [(0.2, 0.175), (1.6, 0.775)], (2, 2, True, 0)),
    ([(0.6, 0.8, 0.8), (0.02, 0.06, 0.3)], {}, "face", [(0, 0.7)], (1, 1, True, 0)),
    ([(0.1, 0.3, 0.8, 10.5, False), (0.7, 0.8, 0.35, 10.5, True)], {}, "face", [(0, 0.75)], (1, 1, True, 0)),
    ([(0.7, 0.8, 0.6, 10.5), (0.1, 0.2, 0.6, 30.0)], {}, "face", [(0, 0.75)], (1, 1, True, 0)),
    ([(0.1, 0.2, 0.6, 30.0)], {}, "face", [(0, WIDTH / 2)], (1, 1, True, 0)),
    ([], {"motion": 0.95}, "motion", [(0, 1 - WIDTH / 2)], (0, 0, None, 0)),
    ([], {}, "center", [(0, 0.5)], (0, 0, None, 0)),
    (PAIR, {"aspect": 9 / 16, "motion": 0.9}, "center", [(0, 0.5)], (0, 0, None, 0)),
]


@pytest.mark.parametrize("faces, how, mode, keys, counts", CASES)
def test_known_windows(spark, faces, how, mode, keys, counts):
    r = frame(spark, faces, **how)
    assert r.mode == mode and [x for k in r["keys"] for x in k] == pytest.approx([x for k in keys for x in k])
    assert (r.faces, r.inside, r.main_inside, r.center_inside) == counts
    if mode in ("fit", "center"):
        assert r.width == 1.0 or how.get("aspect") is None
        assert (r.focus_x, r.focus_y) == (0.5, 0.5)
    if mode == "pan":
        assert (r.focus_x, r.focus_y) == pytest.approx((0.5, 0.45))


def test_window_moves_with_ease(spark):
    r = spark.createDataFrame([(t,) for t in (0.0, 0.4, 1.0, 1.6, 3.0)], "t double")
    keys = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(x).alias("center")) for a, x in ((0.4, 0.2), (1.6, 0.8))])
    got = [x.c for x in r.orderBy("t").select(framing.center_at(keys, F.col("t")).alias("c")).collect()]
    assert got == pytest.approx([0.2, 0.2, 0.5, 0.8, 0.8])


def plain(shot, faces, rules):
    """Counts of one shot, its mode and the middles of its keys, face by face."""
    _, a, z, duration, aspect, _ = shot
    width = min(1, 0.5625 / aspect)
    use = [f for f in faces if a - rules.around <= f[2] <= z + rules.around] or faces
    use = [f for f in use if f[8]] or [f for f in use if f[6] - f[4] >= rules.least_share * max(g[6] - g[4] for g in use)]
    at = {f[1]: min(max(f[2] - a, 0), duration) for f in use}
    lead = sorted(use, key=lambda f: (-f[8], -(f[6] - f[4]), -f[7], f[1]))[0]
    mid = lambda fs: min(max((min(f[3] for f in fs) + max(f[5] for f in fs)) / 2, width / 2), 1 - width / 2)
    size = lambda fs: max(f[5] for f in fs) - min(f[3] for f in fs)
    groups = {t: [f for f in use if at[f[1]] == t] for t in sorted(at.values())}
    room = width * (1 - 2 * rules.margin)
    if size(use) <= room:
        mode, places = "face", {t: [mid(use)] for t in groups}
    elif len(groups) > 1 and all(size(g) <= room for g in groups.values()):
        mode, places = "face", {t: [mid(g)] for t, g in groups.items()}
    else:
        far = sorted(use, key=lambda f: (-abs(f[3] + f[5] - lead[3] - lead[5]), f[1]))[0]
        mode = "pan" if duration >= rules.pan_from else "main"
        places = {t: [mid([lead])] + [mid([far])] * (mode == "pan") for t in groups}
    seen = [f for f in use if any(f[3] >= p - width / 2 - rules.slack and f[5] <= p + width / 2 + rules.slack for p in places[at[f[1]]])]
    return mode, len(use), len(seen), lead in seen


def test_random_shots(spark):
    draw, rules = random.Random(3), FrameRules()
    shots = [(k, 10.0, 12.0, draw.choice([1.0, 2.0]), draw.choice([1.0, 16 / 9]), None) for k in range(300)]
    faces, n = [], 0
    for k in range(300):
        for _ in range(draw.randrange(1, 6)):
            n += 1
            x, w = draw.randrange(0, 800) / 1000 if k % 2 else 0.4 + draw.randrange(0, 200) / 1000, draw.randrange(30, 120) / 1000
            faces.append((k, n, draw.choice([9.0, 10.5, 11.0, 12.25, 20.0]), x, 0.25, x + w, 0.25 + draw.randrange(1, 9) / 16, draw.randrange(4) / 4, draw.random() < 0.1))
    df = spark.createDataFrame(faces, FACE)
    got = {r.shot: (r.mode, r.faces, r.inside, r.main_inside) for r in framing.frame_shots(spark.createDataFrame(shots, SHOT), df, ["shot"], rules).collect()}
    assert got == {s[0]: plain(s, [f for f in faces if f[0] == s[0]], rules) for s in shots}
    assert {m for m, *_ in got.values()} == {"face", "pan", "main"}


def test_nulls_strays_and_nothing(spark):
    shots = spark.createDataFrame([(1, 10.0, 12.0, 2.0, 16 / 9, None), (2, 10.0, 12.0, 2.0, None, 0.3)], SHOT)
    faces = spark.createDataFrame([(1, 1, None, 0.1, 0.1, 0.2, 0.2, 0.5, True), (1, 2, 11.0, 0.3, 0.1, 0.4, 0.4, None, None), (9, 3, 11.0, 0.3, 0.1, 0.4, 0.4, 0.9, True), (2, 4, 11.0, 0.3, None, 0.4, 0.4, 0.9, True)], FACE)
    got = {r.shot: (r.mode, r.faces) for r in framing.frame_shots(shots, faces, ["shot"]).collect()}
    assert got == {1: ("face", 1), 2: ("center", 0)}
    assert framing.frame_shots(shots.limit(0), faces, ["shot"]).count() == 0
    totals = {r["mode"]: (r.shots, r.faces, r.with_faces) for r in framing.summary(framing.frame_shots(shots, faces.limit(0), ["shot"]), []).collect()}
    assert totals == {"center": (2, 0, 0)}
