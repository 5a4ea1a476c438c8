"""The prefix trie against brute force over all prefixes: many ranges, hot turns, chains, equal and empty conversations, nulls, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from contextlib import contextmanager

import duckdb
import pytest
from tessella.llm import prefix_trie, queries

LEAST = -(2**63)
KINDS = "conv_id long, turn long, role string, text string, seq string, n int, key string"


@contextmanager
def conf(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        convs[LEAST if conv is None else conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), sum(not children[q] for q in below), saved, digest))
    return sorted(map(repr, out))


def got(spark, rows):
    turns = spark.createDataFrame(rows, KINDS).repartition(5)
    df = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(turns)))
    return sorted(repr((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in df.collect())


def some_turns(seed, many):
    draw, rows = random.Random(seed), []
    for c in range(many):
        hot = draw.random() < 0.34
        for t in range(draw.choice([1, 1, 2, 3, 4, 6, 9])):
            text = "hot words here" if hot and t < 3 else " ".join(["a", "b c", "d", ""][draw.randrange(4)] for _ in range(draw.randrange(3)))
            rows.append((c, t, draw.choice(["user", "user", "assistant", None]) if not hot else "user", text, "x", 1, None))
    long = [(9001, t, "user", "same long", None, None, None) for t in range(60)] + [(9002, t, "user", "same long", None, None, None) for t in range(45)]
    odd = [(None, 2, "user", "no id", "", 0, ""), (None, None, None, None, "", 0, ""), (-7, 1, "user", "x" * 100_000, "", 0, ""), (-7, 1, "user", "tie", "", 0, ""), (-7, 1, "user", "tie", "", 0, ""), (-20, None, "a", "null turn", "", 0, "")]
    return rows + long + odd


@pytest.mark.parametrize("ranges", ["1", "9", "40"])
def test_nodes_against_brute_force(spark, ranges):
    rows = some_turns(int(ranges), 260)
    with conf(spark, spark__sql__shuffle__partitions=ranges, spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert got(spark, rows) == brute(rows)


def test_points_met_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_POINTS", -1)
    rows = some_turns(3, 80)
    with conf(spark, spark__sql__shuffle__partitions="6", spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert got(spark, rows) == brute(rows)


def test_hot_ends_are_hashed_piece_by_piece(spark, monkeypatch):
    ids = [(b"k" if i % 3 else bytes([i % 7]), i) for i in range(4000)] + [(b"z", 3), (b"a", -5)]
    want = {k: hashlib.sha256(",".join(str(i) for j, i in sorted(ids) if j == k).encode()).hexdigest() for k in {k for k, _ in ids}}
    df = spark.createDataFrame(ids, "key binary, conv long")
    with conf(spark, spark__sql__shuffle__partitions="11", spark__sql__adaptive__coalescePartitions__enabled="false"):
        rows = [(bytes(r.key), r.ends) for r in prefix_trie.ends_of(df).collect()]
    assert len(rows) == len(want) and dict(rows) == want
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 10)
    pieces = prefix_trie._hash_runs(iter(df.orderBy("key", "conv").toArrow().to_batches()))
    assert sum(not done for b in pieces for done in b["done"].to_pylist()) > 2


def test_conversations_without_turns_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only", "", 0, "") for c in range(41, 60)]  # the first of the block has no rows
    assert any(int(x.split(", ")[1]) == 0 and not x.endswith(repr(prefix_trie.NOTHING) + ")") for x in got(spark, rows))
    assert got(spark, rows) == brute(rows)
    alone = [(41 + k, 0, "user", "x", "", 0, "") for k in range(19) if zlib.crc32(str(41 + k).encode()) % 4]
    assert got(spark, alone) == brute(alone) and len(brute(alone)) == 1


def test_no_rows(spark):
    assert got(spark, []) == []


def test_op13_against_sql(spark, small):
    duckdb.sql(f"create or replace view conversations as select * from '{small}/conversations.parquet'")
    out = queries.op13_prefix_trie(spark, small)
    want = duckdb.sql(queries.OP13_SQL).select(*out.columns).fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
