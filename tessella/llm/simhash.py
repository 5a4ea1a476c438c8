"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Fingerprints of 64 bits are cut into six blocks. Two of them that differ in
at most three bits agree on at least three whole blocks, so they meet under at
least one of the twenty keys (which blocks, their bits). Each key fixes 31 to
33 bits, hence buckets stay small on large inputs too. Buckets that are still
large are cut again over their free bits in the same way; after that a bucket
has at most 2**17 members by construction, so no task is unbounded. A bucket
passes on a spanning forest of its verified links and never all its pairs;
the connected components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, written

BITS = 64
#: Widths of the six blocks, from the lowest bit.
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Buckets with more fingerprints than this are cut again by their free bits.
LARGE_BUCKET = 2048


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words of the text, A-Z lower-cased, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops)]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half the hashes; zero without any."""
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        octets = hashes[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``id_col`` and ``fp``, the fingerprint as a signed long. Null and wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def _block_keys(free: list[tuple[int, int]], share: int) -> list[int]:
    """Masks over every choice of ``share`` of the blocks given as (first bit, width)."""
    blocks = [((1 << w) - 1) << at for at, w in free]
    return [sum(c) for c in combinations(blocks, share)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks() -> list[int]:
    starts = np.cumsum((0, *WIDTHS)).tolist()
    return _block_keys(list(zip(starts, WIDTHS)), 3)


def _finer_masks(mask: int) -> list[int]:
    """Masks that extend ``mask`` by half of its free bits: six runs of free bits, three of which must agree."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    runs = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), 6)]
    return [mask | sum(c) for c in combinations(runs, 3)]


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between the values at ``distance`` bits or less, as many as connect what is connected: (smallest of the component, other)."""
    order = np.sort(values)
    u = order.view(np.uint64)
    label = [-1] * len(u) if len(u) <= 48 else np.full(len(u), -1)
    plain = u.tolist() if len(u) <= 48 else None
    for root in range(len(u)):
        if label[root] >= 0:
            continue
        label[root], queue = root, [root]
        while queue:
            x = queue.pop()
            if plain:
                near = [i for i in range(root + 1, len(plain)) if label[i] < 0 and (plain[i] ^ plain[x]).bit_count() <= distance]
                for i in near:
                    label[i] = root
                queue += near
            else:
                rest = np.flatnonzero(label < 0)
                near = rest[np.bitwise_count(u[rest] ^ u[x]) <= distance]
                label[near] = root
                queue.extend(near.tolist())
    return [(int(order[r]), int(order[i])) for i, r in enumerate(label) if r != i]


def _bucket_links(buckets: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """The forests of all buckets (rows with equal ``keys``), bucket after bucket from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(keys) + 1), np.int64)
        for b in chain(batches, [None]):
            rows = held if b is None else np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)])
            cuts = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
            parts = np.split(rows[:, -1], cuts)
            if b is not None:  # the last bucket may go on
                held = rows[cuts[-1] if len(cuts) else 0 :]
                parts.pop()
            found = [link for part in parts if len(part) > 1 for link in forest(part, distance)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    dealt = buckets.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("key")) for m, k in enumerate(masks)])
    return fps.select("fp", F.explode(pairs).alias("k")).select("k.m", "k.key", "fp")


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints at ``distance`` (at most 3) or less bits, enough for the components."""
    if not 0 <= distance <= 3:
        raise ValueError("six blocks find distances up to 3")
    masks = _masks()
    keyed = _keyed(fps, masks)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    sized = keyed.groupBy("m", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sized = written(sized, "buckets")
    pairs = sized.where("n = 2").where(close).select("a", "b")
    members = keyed.join(sized.where("n > 2").select("m", "key", "n"), ["m", "key"])
    small = _bucket_links(members.where(F.col("n") <= LARGE_BUCKET), ["m", "key"], distance)
    out = pairs.unionByName(small)
    if not sized.where(F.col("n") > LARGE_BUCKET).isEmpty():
        table = F.array(*[F.array(*[F.lit(_signed(k)) for k in _finer_masks(m)]) for m in masks])
        finer = (
            members.where(F.col("n") > LARGE_BUCKET)
            .select("m", "fp", F.posexplode(F.element_at(table, F.col("m") + 1)).alias("m2", "mask"))
            .select("m", "m2", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        )
        out = out.unionByName(_bucket_links(finer, ["m", "m2", "key"], distance))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the edges (``a``, ``b``); the root is the smallest node of the component.

    Large-star and small-star steps in turn until nothing changes: every step
    keeps the components, and the number of rounds grows with the logarithm of
    the longest path. Each round is a table in the shared folder. Only whether
    it changed anything comes back to the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(lowest, "u")
        if large:
            return moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        kept = lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))
        return moved.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(kept)

    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        summary = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if summary == before or summary[0] == 0:
            break
        before = summary
        now = written(star(star(now, True).distinct(), False).where("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id reachable over links, its own included) for every row.

    Fingerprints link at ``distance`` or fewer differing bits; equal ones
    always. Null texts and texts without words have fingerprint zero and link
    like any other. Repeated rows give repeated results; an id given to several
    texts stands in each of their components; null ids are below every id and
    make the component's id null only if no row has one. An empty table gives
    an empty result. Further columns of ``docs`` are not looked at.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct")
    roots = written(components(links(first.select("fp"), distance)), "roots")
    member = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = member.join(lowest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(id_col, "fp", "component_id")
