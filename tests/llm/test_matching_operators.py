"""Near-duplicates, fingerprints, decontamination, chat formatting and archives against brute force, exact round trips and SQL."""

import functools
import hashlib
import random
import re
import struct
from itertools import combinations

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import chat, decontam, queries, simhash, syncmers, warc
from tessella.llm.common import neighbours, new_path


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_near_duplicates_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    roots = brute_components(prints)
    rows = queries.op2_simhash_near_dedup(spark, small).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", roots[i]) for i, p in prints.items()}


@pytest.mark.parametrize("large", [2048, 4])
def test_links_find_all_components(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    draw, values = random.Random(large), set()
    for _ in range(60):
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 3, 40])):  # walks, so that chains are long
            values.add(x)
            for b in draw.sample(range(64), draw.randint(1, 5)):
                x ^= 1 << b
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute_components(signed)
    got = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    assert {s: got.get(s, s) for s in signed} == want


def test_near_duplicate_edges(spark):
    rows = [(5, None, 1), (3, "", 1), (9, " \n", 1), (7, "one two", 1), (8, "One TWO", 1), (8, "One TWO", 1), (None, "other words here now", 1)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out) == [("3", 3), ("5", 3), ("7", 7), ("8", 7), ("8", 7), ("9", 3), ("None", None)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours_over_ranges(spark):
    keys = spark.createDataFrame([(i * 7 % 1000, i) for i in range(1000)], "k int, v int")
    rows = neighbours(keys, [F.col("k").desc()], ["k"]).collect()
    assert len(rows) == 1000
    assert all((r._next.k if r._next else None) == (r.k - 1 if r.k else None) and (r._prev.k if r._prev else None) == (r.k + 1 if r.k < 999 else None) for r in rows)


UNSPACED = "\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f"


def brute_anchors(text):
    """Closed syncmers by loops: (symbol position, 32 bits of the hash). Spark's hashes are XXH64 with seed 42, of longs one after another."""
    chained = lambda hs: functools.reduce(lambda seed, h: xxhash.xxh64_intdigest(struct.pack("<q", h), seed), hs, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    symbols = []
    for run in re.findall(f"[{UNSPACED}]|[^\\s{UNSPACED}]+", text or ""):
        symbols += [run] if len(run) <= 24 else list(run)
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in symbols]
    g = [signed(chained(p)) for p in zip(h, h[1:])]
    found = [(k, chained((g[k], g[k + 2], g[k + 3])) >> 32) for k in range(len(h) - 4) if min(g[k : k + 4]) in (g[k], g[k + 3])]
    return found or ([(0, chained(h) >> 32)] if h else [])


def brute_likeness(a, b):
    first = lambda x: {h: p for p, h in reversed(x)}
    x, y = first(a), first(b)
    if sorted(x.items()) == sorted(y.items()):
        return 1.0
    met = sorted((x[h], y[h]) for h in x if h in y)
    near = lambda i, j: 0 <= j < len(met) and met[i][0] - met[i][1] == met[j][0] - met[j][1]
    kept = sum(near(i, i - 1) or near(i, i + 1) for i in range(len(met)))
    return kept / max(1, len(x) + len(y) - kept)


def printed(found):
    return ",".join(f"{p}:{h:x}" for p, h in found)


def test_fingerprints_against_brute_force(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choices(["a", "bb", "ccc", "the", "of", "x" * 40, "日本語テキスト", "Ünïcode"], k=n)) for n in (0, 1, 3, 4, 5, 6, 30, 200)] + [None, " \n\t ", "中" * 50, "y" * 24, "y" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.f for r in df.select("i", syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f")).collect()}
    assert got == {i: printed(brute_anchors(t)) for i, t in enumerate(texts)}


def test_fingerprint_query(spark, small):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in queries.op3_syncmer_fingerprints(spark, small).collect()}
    assert len(rows) == len(docs)
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r, own = rows[i], brute_anchors(t)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == printed(own) and r.edited_fingerprint == printed(brute_anchors(edited))
        assert abs(r.near_edited - brute_likeness(own, brute_anchors(edited))) < 1e-12 and abs(r.near_next - brute_likeness(own, brute_anchors(nxt))) < 1e-12
    long = [rows[i] for i, t in docs if len(t) > 1500]
    assert sum(r.near_edited for r in long) / len(long) > 0.35 and sum(r.near_next for r in long) / len(long) < 0.1


def test_shifted_texts_are_alike(spark):
    draw = random.Random(8)
    han = "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(2000))
    latin = " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(300))
    pairs = [(han, "a" + han), (latin, "One more. " + latin), (latin.replace(" ", ""), "ab" + latin.replace(" ", "")), (latin, latin[::-1])]
    of = lambda c: syncmers.firsts(syncmers.anchors(F.col(c)))
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(syncmers.likeness(of("a"), of("b"))).collect()]
    assert min(got[:3]) > 0.9 and got[3] < 0.05


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f g", 1), (2, None, 1), (2, "zz", 1), (9, "é" * 10, 1)], "doc_id long, text string, next_start int")
    rows = sorted((str(r.id), r.text, r.next_start, r.next_size) for r in syncmers.with_next(df, derived={"size": F.length("text")}).collect())
    assert rows == [("2", "", "", 13), ("2", "zz", "", 13), ("9", "é" * 10, "", 0), ("None", "a b c d e f g", "éééé", 10)]
    assert syncmers.with_next(df.limit(0)).count() == 0
    one = syncmers.with_next(df.limit(1)).collect()
    assert [r.next_start for r in one] == ["a b "]
    many = [(i, f"{i} " * 3) for i in range(3000)]
    got = {r.id: r.next_start for r in syncmers.with_next(spark.createDataFrame(many, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: many[i - 1][1][: len(t) // 3] for i, t in many}
    same = " ".join(f"w{i}" for i in range(40))
    m = syncmers.positional_matches(spark.createDataFrame([(f"x y z {same}", same), (None, "a")], "left_text string, right_text string")).collect()
    assert len(m[0].matches) > 10 and all(p.left_pos == p.right_pos + 3 for p in m[0].matches) and m[1].matches == []
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 60_000)], "doc_id long, text string").select(F.size(syncmers.anchors(F.col("text"))))
    assert long.first()[0] > 0


def oracle(sql, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return sorted(rel.columns), sorted(map(repr, rel.project(", ".join(sorted(rel.columns))).fetchall()))


@pytest.mark.parametrize("name", ["op4_warc_archives", "op5_chat_formatting", "op6_benchmark_decontamination"])
def test_queries_equal_sql(spark, small, name):
    df = queries.queries()[name](spark, small)
    columns, want = oracle(queries.oracle_sql()[name], small)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_decontamination_cases(spark):
    item = " ".join(f"W{i}" for i in range(20))
    bench = spark.createDataFrame([("b", item), (None, "Short one"), ("e", "!!"), ("n", None)], "item_id string, text string")
    first = " ".join(f"w{i}" for i in range(13))
    rows = [
        (1, f"aa, {first} zz"), (2, f"{first[:-1]}"), (3, None), (4, ""), (5, "x SHORT, one y short one"), (6, item.replace(" ", "--")), (6, "other"), (None, first), (7, first + " " + first),
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), r.n_words, [(s.start, s.end) for s in r.spans], list(r["items"])) for r in decontam.contamination(docs, bench).collect())
    assert got == [
        ("1", 15, [(1, 14)], ["b"]), ("2", 13, [], []), ("3", 0, [], []), ("4", 0, [], []), ("5", 6, [(1, 3), (4, 6)], ["null"]), ("6", 1, [], []), ("6", 20, [(0, 20)], ["b"]),
        ("7", 26, [(0, 26)], ["b"]), ("None", 13, [(0, 13)], ["b"]),
    ]
    clean = decontam.contamination(docs, bench, keep=("text",)).where("doc_id in (1, 5)").select("doc_id", decontam.without_spans(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in clean.collect()} == {1: "aa,  zz", 5: "x  y "}
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert all(r.spans == [] for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nx", "\\", "\\\\n<s></s>", "[INST][/INST]<<SYS>><</SYS>>", "", None, "a\\<|im_end|>", "é🙂\n\n", "<\\|im_end|>"]
    rows = [(1, i, ["user", "assistant", "sys\ntem", None][i % 4], t, 0) for i, t in enumerate(nasty)] + [(2, 0, "user", "only", 0), (None, None, "assistant", "x", 0), (3, 1, "assistant", "dup", 0), (3, 1, "assistant", "dup", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    made = chat.examples(df)
    out = made.select("conv_id", "example", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.example)
    assert [(t.role, t.text) for t in one[-1].t] == [(r or "", t or "") for _, _, r, t, _ in rows[: len(nasty)]]
    assert [r.loss for r in one] == [nasty[1], nasty[5] or "", ""]
    assert all(not any(m in f for m in chat.CONTROL) for r in one for f in re.split(r"<\|im_start\|>|<\|im_end\|>\n", r.formatted))
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(one, one[1:]))
    assert sorted((str(r.conv_id), r.loss) for r in out if r.conv_id != 1) == [("2", ""), ("3", "dup"), ("3", "dup"), ("None", "x")]
    assert chat.examples(df.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "u1\r\nX: y", big, 1), (5, None, big, 1), (5, "u5", big, 1), (2, "u2", "tiny", 1), (3, "u3", "tiny", 1), (4, None, None, 1), (None, "n", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    path = new_path(spark, "test-archives")
    warc.write_archives(warc.page_records(pages).repartition(3), path, file_bytes="100")
    got = sorted((str(warc_id), r.warc_type, str(r.refers), r.payload_length, (r.payload or b"").decode()) for r in warc.read_archives(spark, path).withColumns({"id": warc.page_of(F.col("record_id")), "refers": warc.page_of(F.col("refers_to"))}).collect() for warc_id in [r.id])
    n = len(big.encode())
    assert got == [
        ("1", "revisit", "5", n, ""), ("2", "response", "None", 4, "tiny"), ("3", "response", "None", 4, "tiny"), ("4", "response", "None", 0, ""),
        ("5", "response", "None", n, big), ("5", "response", "None", n, big), ("None", "revisit", "5", n, ""),
    ]
    back = warc.read_archives(spark, path, payload="false")
    assert back.where("warc_type = 'revisit'").count() == 2 and back.where("target_uri = 'u2'").select("payload_sha1").first()[0] == hashlib.sha1(b"tiny").hexdigest()
    assert back.where("warc_type in ('response', 'x') and record_id = '<urn:page:2>'").count() == 1
    empty = new_path(spark, "test-empty")
    warc.write_archives(warc.page_records(pages.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_of_others(tmp_path):
    """Plain archives and gzip members without lengths are read; blocks of unwanted records are stepped over."""
    import gzip

    recs = [warc.record({"WARC-Type": k, "WARC-Record-ID": f"<{i}>", "Content-Type": "text/plain"}, b"x" * (i * 50_000)) for i, k in enumerate(["warcinfo", "response", "request", "response"])]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(warc.member(r, 6) for r in recs))
    reader = warc.WarcReader({"path": str(tmp_path), "warc_type": "response"})
    for part in reader.partitions():
        rows = [r for b in reader.read(part) for r in b.to_pylist()]
        assert [(r["record_id"], r["payload_length"]) for r in rows] == [("<1>", 50_000), ("<3>", 150_000)]
