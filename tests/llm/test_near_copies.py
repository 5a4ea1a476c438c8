"""Near copies by word shingles against brute force over all pairs."""

import random
from itertools import combinations

import pytest

import corpus_pipeline as pipeline
from tessella.llm import near_copies, simhash


def brute(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) / union >= 0.8 or (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def edited(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"e{draw.random()}"
    return out


def planted(seed):
    draw, texts = random.Random(seed), ["", " \n", "one two", "One  TWO"]
    menu = [f"m{i}" for i in range(40)]
    for k in range(12):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([8, 40, 150, 600]))]
        texts += [" ".join(edited(draw, base, n)) for n in (0, 0, 1, 2, 4, 8, len(base) // 40)]
        texts.append(" ".join(menu + base[:30]))
    walk = [f"c{i}" for i in range(200)]
    for _ in range(60):  # a chain: its ends are not alike
        texts.append(" ".join(walk))
        walk = edited(draw, walk, 2)
    return {i: t for i, t in enumerate(draw.sample(texts, len(texts)))}


@pytest.mark.parametrize("small, frequent, tile", [(32, 8, 2048), (2, 2, 2048), (2, 1000, 7)])
def test_near_copies_against_brute_force(spark, monkeypatch, small, frequent, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    texts = planted(small)
    got = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(texts) and len(got) == len(texts)


def test_stage_joins_what_fingerprints_miss(spark, small):
    draw = random.Random(5)
    rows = []
    for k in range(20):
        base = [f"w{draw.randrange(5000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(draw, base, 4)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute(dict(rows)).values())
    missed = simhash.near_duplicates(docs).where("doc_id = component_id").count()
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, small).collect()} == want and missed > len(want)
