"""Ranks over ranges and interval joins over stretches against brute force, with many ranges, a hot value, null groups and very long intervals."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tessella.operators import intervals, ranks


@pytest.fixture()
def many(spark):
    names = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def some(spark, seed=1):
    draw = random.Random(seed)
    value = lambda: None if draw.random() < 0.1 else 5.0 if draw.random() < 0.4 else round(draw.random() * 50, 1)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), value()) for i in range(1500)] + [(9000, "one", 3.0), (9001, "none", None)]
    return rows, spark.createDataFrame(rows, "id int, k string, v double").repartition(6)


def groups(rows):
    out = defaultdict(list)
    for i, k, v in rows:
        out[k].append((i, v))
    return out


def test_percentile_ranks(spark, many):
    rows, df = some(spark)
    want = {}
    for own in groups(rows).values():
        vs = [v for _, v in own if v is not None]
        for i, v in own:
            want[i] = None if v is None else 0.5 if len(vs) == 1 else (sum(x < v for x in vs) + (sum(x == v for x in vs) - 1) / 2) / (len(vs) - 1)
    got = {r.id: r.r for r in ranks.percentile_rank(df, ["k"], r="v").collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (w is None) and (w is None or got[i] == pytest.approx(w)) for i, w in want.items())


def test_index_ranks_and_top_shares(spark, many):
    rows, df = some(spark, 2)
    rank, best = {}, set()
    for own in groups(rows).values():
        placed = sorted(((v, i) for i, v in own if v is not None))
        rank |= {i: 0.5 for i, _ in own} | ({i: k / (len(placed) - 1) for k, (_, i) in enumerate(placed)} if len(placed) > 1 else {})
        order = sorted(own, key=lambda x: (x[1] is not None, x[1] or 0, x[0]), reverse=True)
        best |= {i for i, _ in order[: max(1, round(len(own) * 0.3))]}
    got = {r.id: r.r for r in ranks.index_rank(df, ["k"], ["id"], "r", "v").collect()}
    assert got == pytest.approx(rank)
    assert {r.id for r in ranks.top_share(df, "v", ["id"], ["k"], 0.3).collect()} == best


def test_positions_number_each_group(spark, many):
    rows, df = some(spark, 3)
    got = defaultdict(list)
    for r in ranks.positions(df, ["k"], [F.col("id")]).collect():
        got[r.k].append((r.id, r._pos, r._n))
    for k, own in groups(rows).items():
        assert sorted(got[k]) == [(i, p, len(own)) for p, i in enumerate(sorted(i for i, _ in own))]


def test_meeting_intervals(spark, many):
    draw = random.Random(4)
    made = lambda n: [(draw.randrange(3), k, s := draw.randrange(-500, 5000), s + draw.choice([0, 1, 5, 30, 30, 400, 4000])) for k in range(n)]
    a, b = made(300), made(250)
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] > y[2] and x[2] < y[3]}
    df = lambda rows, names: spark.createDataFrame(rows, names)
    met = intervals.meet(df(a, "axis int, seg int, s long, e long"), df(b, "axis int, line int, ls long, le long"), "axis", "s", "e", "ls", "le")
    got = [(r.seg, r.line) for r in met.collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_no_registered_join_has_no_condition(spark, small):
    from tessella.plans.queries import QUERIES

    for name in ("cosine_topk", "zero_shot_sum", "interval_overlap", "overlap_share", "interval_subtract"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_no_intervals_and_no_rows(spark):
    none = spark.createDataFrame([], "axis int, seg int, s long, e long")
    lines = spark.createDataFrame([], "axis int, line int, ls long, le long")
    assert intervals.meet(none, lines, "axis", "s", "e", "ls", "le").count() == 0
    empty = spark.createDataFrame([], "id int, k string, v double")
    assert ranks.percentile_rank(empty, ["k"], r="v").count() == ranks.index_rank(empty, ["k"], ["id"], "r", "v").count() == 0
