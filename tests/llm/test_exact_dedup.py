"""Exact duplicates against brute force: nulls, ties, repeated rows, a hot text, slices, clashing columns, no rows."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from tessella.llm import exact_dedup, queries

KINDS = "doc_id long, text string, h long, sha string, doc string, _again boolean"


def brute(rows):
    """The rows of groups_of, and of each text the largest id."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    low = lambda i: (i is not None, i or 0)
    best = {t: max(ids, key=low) for t, ids in groups.items()}
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: low(r[0]), reverse=True):
        t = r[1] or ""
        out.append((r[0], best[t], len(groups[t]), t not in seen, hashlib.sha256(t.encode()).digest()))
        seen.add(t)
    return out, best


def some_rows():
    draw = random.Random(5)
    texts = ["hot"] * 700 + [f"text {draw.randrange(600)}" for _ in range(1200)] + [None, "", "", None, "é" * 200_000, "é" * 200_000 + "x", "Hot", "hot "]
    rows = [(i, t, 1, "s", "d", True) for i, t in enumerate(texts)]
    return rows + [(None, "hot", 2, None, None, None), (None, "no id", 2, None, None, None), rows[3], rows[900], rows[900], (5000, None, 0, "", "", False)]


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 1 << 16])
def test_groups_against_brute_force(spark, max_bits):
    rows = some_rows() + [(10_000 + i, f"own {i}", None, None, None, None) for i in range(6000)]
    df = spark.createDataFrame(rows, KINDS).repartition(7)
    got = sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha)) for r in exact_dedup.groups_of(df, max_bits=max_bits).collect())))
    assert got == sorted(map(repr, brute(rows)[0]))


def test_deduplicated_keeps_all_columns_of_one_row_a_text(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    out = exact_dedup.deduplicated(df)
    assert out.schema == df.schema
    got = [tuple(r) for r in out.collect()]
    best = brute(rows)[1]
    assert len(got) == len(best) and {(r[1] or ""): r[0] for r in got} == best and set(got) <= set(rows)


def test_a_full_filter_only_costs_time(spark):
    """As many rows as a filter of one block can't hold: all are compared, none is lost."""
    rows = [(i, str(i % 9000)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) h")
    marked = exact_dedup.probed(df, exact_dedup.bloom(df.select("h"), 1, 2), 1)
    assert marked.where("_again").selectExpr("count(distinct text)").first()[0] >= 3000
    assert marked.where("not _again and doc_id % 9000 < 3000").count() == 0


def test_most_single_rows_pass_straight_through(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "xxhash64(id) h")
    blocks = exact_dedup._blocks(20_000, exact_dedup.MAX_BITS)
    assert exact_dedup.probed(df, exact_dedup.bloom(df.select("h"), blocks, 2), blocks).where("_again").count() < 1000


def test_no_rows(spark):
    df = spark.createDataFrame([], KINDS)
    assert exact_dedup.groups_of(df).count() == 0 and exact_dedup.deduplicated(df).count() == 0


def test_op11_against_sql(spark, small):
    duckdb.sql(f"create or replace view documents as select * from '{small}/documents.parquet'")
    out = queries.op11_exact_dedup(spark, small)
    want = duckdb.sql(queries.OP11_SQL).select(*out.columns).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_op11_runs_no_python(spark, small):
    plan = queries.op11_exact_dedup(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
