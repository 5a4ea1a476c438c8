"""Decoded boxes by hand, and suppression in rounds against going through the rows one by one."""

import random

import pytest
from tessella.operators import boxes, series, vectors

RAW = "frame int, rows int, columns int, values array<float>"


def test_both_layouts_and_short_outputs(spark):
    by_row = [10, 20, 30, 60, 0.9, 0, 1, 1, 2, 2, 0.2, 0]
    by_column = [20, 1, 40, 1, 20, 2, 40, 2, 0.1, 0.3, 0.8, 0.2]  # two boxes of middle, size and two classes
    by_row, by_column = ([float(x) for x in v] for v in (by_row, by_column))
    df = spark.createDataFrame([(1, 2, 6, by_row), (2, 6, 2, by_column), (3, 2, 6, by_row[:7]), (4, 4, 9, [0.0] * 36), (5, 0, 6, []), (6, 2, 6, None)], RAW)
    got = sorted((r.frame, r.box_id, r.x, r.y, r.w, r.h, round(r.score, 4)) for r in boxes.decode(df, "frame", 0.25).collect())
    assert got == [(1, 0, 10, 20, 20, 40, 0.9), (2, 0, 10, 20, 20, 40, 0.8), (2, 1, 0, 0, 2, 2, 0.3)]
    (r,) = boxes.in_image(boxes.decode(df.where("frame = 1"), "frame", 0.5), 0.5, 5.0, 10.0, 100.0, 100.0).collect()
    assert (r.x0, r.y0, r.x1, r.y1) == (0.1, 0.2, 0.5, 1.0)


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / (a[2] * a[3] + b[2] * b[3] - both) if both else 0.0


@pytest.mark.parametrize("threshold", [0.0, 0.3])
def test_suppression_of_boxes_in_rounds(spark, threshold):
    draw, rows = random.Random(7), []
    for k in range(400):
        size = 200 if draw.random() < 0.02 else draw.randrange(1, 30)
        rows.append((k % 3, k, float(draw.randrange(-50, 200)), float(draw.randrange(200)), float(size), float(draw.randrange(1, 30)), draw.randrange(30) / 30))
    want = set()
    for frame in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[6], r[1])):
            if all(iou(r[2:6], k[2:6]) <= threshold for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    df = spark.createDataFrame(rows, "frame int, box_id long, x double, y double, w double, h double, score double")
    got = [(r.frame, r.box_id) for r in vectors.nms(df, ["frame"], threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_suppression_along_a_series(spark):
    draw = random.Random(8)
    rows = [(k, i, draw.randrange(20) / 10) for k in range(3) for i in range(120) if draw.random() < 0.6]
    want = set()
    for k in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if len(kept) < 5 and all(abs(r[1] - x[1]) >= 8 for x in kept):
                kept.append(r)
        want |= {*kept}
    df = spark.createDataFrame(rows, "k int, i long, v double")
    assert {tuple(r) for r in series.suppress(df, ["k"], "i", "v", 8, 5).collect()} == want


def test_no_boxes(spark):
    none = spark.createDataFrame([], "frame int, box_id long, x double, y double, w double, h double, score double")
    assert vectors.nms(none, ["frame"]).count() == 0 and boxes.decode(spark.createDataFrame([], RAW), "frame", 0.1).count() == 0
