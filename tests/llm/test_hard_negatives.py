"""Hard negatives against brute force: ties, repeated rows, a third of equal vectors, nulls, vectors of any size, large numbers, no rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import hard_negatives, queries

KINDS = "id long, label long, v array<long>, anchor boolean, cluster string, key int"
LEAST = -(2**63)


def brute(rows, positives=5, negatives=5, low=80, high=100):
    own = [(LEAST if i is None else i, k, label, v, a) for k, (i, label, v, a, *_) in enumerate(rows) if label is not None and v is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, k, label, v, anchor in own:
        if not anchor:
            continue
        scored = sorted((-dot(v, w), j, m, other) for j, m, other, w, _ in own if m != k)
        for s, j, _, other in [x for x in scored if x[3] == label][:positives]:
            hard = [(n, -t) for t, n, _, o in scored if o != label and low * -s <= high * -t <= high * -s][:negatives]
            out += [(i, j, r, n, -s, t) for r, (n, t) in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, KINDS).repartition(4)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("anchor"), **kw).collect()))


def some_rows(seed, many, dim=6, big=40):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, big, (5, dim))
    rows = [(i, int(draw.integers(4)), [int(x) for x in centres[i % 5] + draw.normal(0, big / 3, dim)], i % 9 == 0, "c", 1) for i in range(many)]
    hot = [int(x) for x in centres[0]]
    rows += [(10_000 + i, i % 2, hot, i % 10 == 0, None, None) for i in range(many // 2)]
    return rows


@pytest.mark.parametrize("block, batch", [(1024, 512), (16, 7)])
def test_mine_against_brute_force(spark, monkeypatch, block, batch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BATCH_QUERIES", batch)
    rows = some_rows(block, 300)
    rows += [rows[0], rows[9], (None, 1, rows[3][2], True, "", 0), (5, None, rows[4][2], True, "", 0), (6, 1, None, True, "", 0), (7, 2, [], True, "", 0), (8, 3, [50, 50], True, "", 0), (9, 9, [1] * 6, True, "", 0), (11, 0, [-30] * 6, None, "", 0)]
    found = got(spark, rows)
    assert found == brute(rows) and len(found) > 500
    assert got(spark, rows, positives=2, negatives=3, low=50, high=90) == brute(rows, 2, 3, 50, 90)


def test_ties_come_by_the_smaller_id(spark):
    rows = [(i, i % 2, [10, 0], i == 0, "", 0) for i in range(40)]
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == brute(rows) == [(0, p, r, 2 * r - 1, 100, 100) for p in (2, 4, 6, 8, 10) for r in range(1, 6)]


@pytest.mark.parametrize("big", [10**6, 3 * 10**8])
def test_large_numbers_stay_exact(spark, big):
    rows = some_rows(2, 60, big=big)
    assert got(spark, rows) == brute(rows)


def test_sums_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError, match="fit a long"):
        got(spark, [(0, 1, [2**62, 1], True, "", 0)])


def test_few_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, 1, [1], False, "", 0)]) == []
    two = [(1, 1, [3], True, "", 0), (2, 1, [3], True, "", 0), (3, 0, [3], False, "", 0)]
    assert got(spark, two) == brute(two) == [(1, 2, 1, 3, 9, 9), (2, 1, 1, 3, 9, 9)]


def test_whole_vectors(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)], "embedding array<float>")
    assert [r[0] for r in df.select(hard_negatives.whole_vectors(df)).collect()] == [[128, -1], None, None, None, None, []]
    assert math.floor(256 * -0.001) == -1


def test_bounds_spare_most_lists(spark):
    """On rows in far groups a query visits few of the lists."""
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1000, (30, 8))
    x = np.concatenate([c + draw.normal(0, 5, (40, 8)) for c in centres]).astype(int)
    cents = hard_negatives.fit(x, 30)
    search = hard_negatives.Search(cents, "<i8", True, 5, 5, 80, 100)
    near, far = hard_negatives._nearest(x, cents)
    for c in set(near.tolist()):
        search.radii[c], search.there[c] = far[near == c].max(), True
    batch = hard_negatives.Batch([b"k"], [0], x[:1], len(cents), search)
    for c in batch.wanted(search):
        if c in batch.wanted(search):
            own = np.flatnonzero(near == c)
            batch.meet(int(c), own, own, np.zeros(len(own), int), x[own], search)
    assert len(batch.best[0]) == 6 and batch.seen.sum() <= 0.2 * search.there.sum()
    assert [-b[0] for b in batch.best[0]] == sorted((x @ x[0]).tolist(), reverse=True)[:6]


def test_op12_against_sql(spark, small):
    duckdb.sql(f"create or replace view embeddings as select * from '{small}/embeddings.parquet'")
    out = queries.op12_hard_negatives(spark, small)
    want = duckdb.sql(queries.OP12_SQL).select(*out.columns).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and want
