"""Near copies by the exact likeness of their word shingles, together with the links of SimHash fingerprints.

A text is the set of its shingles of five words. Two sets whose Jaccard
likeness is at least t share at least t times the larger one. So if all
shingles have one global order, the first n - ceil(t n) + 1 of each set (its
prefix) have a member in common, and no pair is lost that way. Shingles that
are frequent in a sample of the texts come last in the order, which keeps
buckets small; the order changes the work, never the result.

Members of prefixes travel once, to the buckets of equal shingles. Small
buckets give all their pairs. Of large ones (a group of near copies, a common
passage) members first meet a few pivots, the members most made of frequent
shingles among them, since the text that others were made from is such. Only
members that are in different components after that meet each other, in
tiles, inside a task.

A bit map of the parities of the shingles, with about a bit for each shingle,
sorts out most pairs: two maps differ in at most as many bits as the sets in
shingles. The whole sets decide on the others, first on every text and its
nearest candidate, then on what that leaves in different components. A pair
within one component is not decided, because it changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import simhash
from tessella.llm.common import bounded_batches, sieve, written

WIDTH, LEAST = 5, 0.8
#: One text of so many is asked for frequent shingles; those in ``FREQUENT`` of them come last, as far as ``LISTED`` go.
SAMPLED, FREQUENT, LISTED = 32, 4, 200_000
#: Buckets up to this size pass on all their pairs; members of larger ones meet ``PIVOTS`` others, then those in other components, ``TILE`` by ``TILE``.
SMALL_BUCKET, PIVOTS, TILE = 32, 3, 2048
#: Longs of the smallest bit map. Larger ones have the next power of two for a bit a shingle, and fold to smaller ones.
MAP_LONGS = 16


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text as signed longs, ascending."""
    return np.unique(simhash.shingle_hashes(text, width)).view(np.int64)


def set_key(found: np.ndarray) -> int:
    """One signed hash of a set; equal sets have equal ones."""
    return xxhash.xxh64_intdigest(found.tobytes(), 5) - (1 << 63)


def prefix(found: np.ndarray, least: float, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The first n - ceil(least * n) + 1 of a set in the order of the hashes with ``frequent`` ones (ascending) last, by their ``ranks``: those that are not
    frequent, those that are. And the share of the whole set that is frequent."""
    size = len(found) - int(np.ceil(least * len(found) - 1e-6)) + 1
    if not len(found) or not len(frequent):
        return found[:size], found[:0], 0.0
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    last = frequent[at] == found
    rare, common = found[~last], found[last][np.argsort(ranks[at[last]])]
    return rare[:size], common[: max(0, size - len(rare))], len(common) / len(found)


def bit_map(found: np.ndarray) -> np.ndarray:
    """For each of the map's bits, whether an odd number of the hashes falls to it."""
    bits = max(64 * MAP_LONGS, 1 << (len(found) - 1).bit_length()) if len(found) else 64 * MAP_LONGS
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """The map of ``longs`` longs that a larger one (the last axis) stands for."""
    while bits.shape[-1] > longs:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``key`` and ``shingles`` of each row's ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    return texts.select("text").mapInArrow(run, "key long, shingles array<long>")


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts have, ascending, and their ranks by frequency."""
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    counts = _sets(some, width).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    found = [r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(LISTED).collect()]
    frequent = np.array(found[::-1], np.int64)
    order = np.argsort(frequent)
    return frequent[order], order


def _prints(rows: DataFrame, width: int, least: float) -> DataFrame:
    """For each row ``id``, its SimHash ``fp``, and of its set: ``key``, size ``n``, bit map ``bits``, prefix (``rare``, ``common``), frequent ``share``."""
    frequent, ranks = _frequent(rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.array([simhash.fingerprint(simhash.shingle_hashes(t)) for t in texts], np.uint64).view(np.int64)
            sets = [shingle_set(t, width) for t in texts]
            rare, common, share = zip(*[prefix(s, least, frequent, ranks) for s in sets]) if sets else ((), (), ())
            columns = [
                pa.array(fps), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bit_map(s) for s in sets], pa.list_(pa.int64())),
                pa.array(rare, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64())), pa.array(share, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "fp", "key", "n", "bits", "rare", "common", "share"])

    longs = T.ArrayType(T.LongType())
    kinds = {"fp": T.LongType(), "key": T.LongType(), "n": T.IntegerType(), "bits": longs, "rare": longs, "common": longs, "share": T.DoubleType()}
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *[T.StructField(c, k) for c, k in kinds.items()]]))


def _pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs of different keys, the lesser first, as an array of two columns."""
    both = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    return np.unique(both[both[:, 0] != both[:, 1]], axis=0)


def _within(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of those sizes can be alike."""
    return np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6


def _buckets(items: DataFrame, least: float) -> DataFrame:
    """From members (``s``, ``key``, ``n``) of buckets of equal ``s``: the pairs of small buckets (``a``, ``b``, -1) and the members of large ones (``s``, ``key``, ``n``).

    Buckets come from sorted partitions; a task holds no more than a batch and
    a small bucket, however large a bucket is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed = np.zeros((0, 3), np.int64), None  # the last bucket so far; one of which members were given out already
        for part in chain(batches, [None]):
            rows = held if part is None else np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns], axis=1)])
            if not len(rows):
                continue
            starts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            large = sizes > SMALL_BUCKET
            large[0] |= passed is not None and rows[0, 0] == passed
            held = rows[:0]
            if part is not None and not large[-1]:  # may go on
                held, starts, sizes, large = rows[starts[-1] :], starts[:-1], sizes[:-1], large[:-1]
            passed = rows[-1, 0] if len(large) and large[-1] and not len(held) else None
            out = [rows[: sizes.sum()][np.repeat(large, sizes)]]
            for size in np.unique(sizes[~large & (sizes > 1)]):
                at = starts[~large & (sizes == size)][:, None] + np.arange(size)
                i, j = np.triu_indices(size, 1)
                near = _within(rows[at, 2][:, i], rows[at, 2][:, j], least)
                found = _pairs_of(rows[at, 1][:, i][near], rows[at, 1][:, j][near])
                out.append(np.column_stack([found, np.full(len(found), -1)]))
            out = np.concatenate(out)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], ["a", "b", "n"])

    return items.repartition("s").sortWithinPartitions("s").mapInArrow(run, "a long, b long, n long")


def _tiles(members: DataFrame, least: float) -> DataFrame:
    """Candidates (``a``, ``b``) with different ``root`` among the members of equal ``s``, tile by tile, and by how many bits they are ``apart``.

    Members have ``s``, ``key``, ``n``, ``root``, ``bits``, ``blocks`` (of the
    bucket) and ``all``, their large buckets. A pair that meets in several
    buckets is given out in the least of them.
    """
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("s", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "n", "root", "bits", "all")
    share = (1 - least) / (1 + least)

    def pairs(g: np.ndarray, maps: list[np.ndarray], buckets: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """Of one tile, rows of (s, x, y, own, key, n, root)."""
        first, small, found = g[:, 3] == g[0, 1], np.stack([folded(m, MAP_LONGS) for m in maps]), []
        left, right = np.flatnonzero(first), np.flatnonzero(~first) if g[0, 1] != g[0, 2] else np.flatnonzero(first)
        for i in left:
            near = right[(g[right, 6] != g[i, 6]) & _within(g[right, 5], g[i, 5], least)]
            limit = share * (g[near, 5] + g[i, 5]) + 1e-6
            for j, most in zip(near, np.where(np.bitwise_count(small[near] ^ small[i]).sum(axis=1) <= limit, limit, -1)):
                if most >= 0:
                    longs = min(len(maps[i]), len(maps[j]))
                    apart = int(np.bitwise_count(folded(maps[i], longs) ^ folded(maps[j], longs)).sum())
                    if apart <= most and np.intersect1d(buckets[i], buckets[j], assume_unique=True)[0] == g[i, 0]:
                        found.append((*sorted((int(g[i, 4]), int(g[j, 4]))), apart))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, maps, buckets = np.zeros((0, 7), np.int64), [], []
        for part in chain(batches, [None]):
            if part is not None:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[:7]], axis=1)])
                maps += [m.values.to_numpy(zero_copy_only=False).view(np.uint64) for m in part.column(7)]
                buckets += [m.values.to_numpy(zero_copy_only=False) for m in part.column(8)]
            cuts = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
            ends = [0, *cuts.tolist(), *([] if part is not None else [len(held)])]
            found = {p for i, j in zip(ends, ends[1:]) if j - i > 1 for p in pairs(held[i:j], maps[i:j], buckets[i:j])}
            held, maps, buckets = held[ends[-1] :], maps[ends[-1] :], buckets[ends[-1] :]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "apart"])

    return dealt.repartition("s", "x", "y").sortWithinPartitions("s", "x", "y").mapInArrow(run, "a long, b long, apart long").distinct()


def _alike(pairs: DataFrame, first: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Those of the distinct pairs of keys (``a``, ``b``) whose whole sets are alike. Only texts that are asked about are read again, and their sets travel."""
    asked = first.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select(F.xxhash64("id").alias("h"))
    sets = _sets(sieve(rows, F.xxhash64("id"), asked).where("_maybe"), width)
    named = lambda k: sets.select(F.col("key").alias(k), F.col("shingles").alias(f"{k}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(named("a"), "a").join(named("b"), "b").where(both / (F.size("a_set") + F.size("b_set") - both) >= least).select("a", "b").distinct()


def _possible(pairs: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose maps leave them possible, and by how many bits they are ``apart``."""
    sized = lambda k: first.select(F.col("key").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    both = pairs.join(sized("a"), "a").join(sized("b"), "b").where(F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n") - 1e-6)
    # Sizes that can be alike differ by less than half, so their maps are equally large, or one is twice as large.
    longs = F.least(F.size("a_bits"), F.size("b_bits"))
    half = lambda m: F.zip_with(F.slice(m, 1, longs), F.slice(m, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
    fold = lambda m: F.when(F.size(m) > longs, half(m)).otherwise(F.col(m))
    apart = F.aggregate(F.zip_with(fold("a_bits"), fold("b_bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    met = both.select("a", "b", apart.cast("long").alias("apart"), ((1 - least) / (1 + least) * (F.col("a_n") + F.col("b_n")) + 1e-6).alias("most"))
    return met.where("apart <= most").select("a", "b", "apart")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (``a``, ``b``, ``apart``), for each key the one least apart."""
    ends = pairs.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("key"))
    return ends.groupBy("key").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose keys have different roots."""
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*pairs.columns)


def links(prefixes: DataFrame, first: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Links (``a``, ``b``) between keys of alike sets, enough for the components.

    ``prefixes``: ``key``, ``n``, ``rare``, ``common`` of each set; ``first``: its ``key``, ``id`` of a row that has it, ``n``, ``bits``, ``share``.
    """
    met = written(_buckets(prefixes.select(F.explode("rare").alias("s"), "key", "n"), least), "buckets")
    large = met.where("n >= 0").select(F.col("a").alias("s"), F.col("b").alias("key"), F.col("n").cast("int").alias("n"))
    large = written(large.unionByName(prefixes.where(F.size("common") > 0).select(F.explode("common").alias("s"), "key", "n")), "large")
    likely = large.join(first.select("key", "share"), "key").groupBy("s")
    other = [F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(PIVOTS - 1)]
    pivots = likely.agg(F.array(F.max_by("key", F.struct("share", F.xxhash64("key"))), *other).alias("p"))
    stars = large.join(pivots, "s").select("key", F.explode("p").alias("p"))
    pairs = met.where("n < 0").select("a", "b").unionByName(stars.select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b"))).where("a <> b").distinct()
    pairs = written(_possible(pairs, first, least), "candidates")
    nearest = written(_nearest(pairs), "nearest")
    near = written(_alike(nearest, first, rows, width, least), "alike")
    roots = written(simhash.components(near), "roots")
    placed = written(large.join(roots, large["key"] == roots["node"], "left").select("s", "key", "n", F.coalesce("root", "key").alias("root")), "placed")
    mixed = placed.groupBy("s").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    members = placed.join(mixed.select("s", "blocks"), "s")
    every = members.groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("all"))
    members = members.join(every, "key").join(first.select("key", "bits"), "key")
    pairs = _apart(pairs.unionByName(_tiles(members, least)).distinct(), roots)
    pairs = written(pairs.join(nearest, ["a", "b"], "left_anti"), "candidates")
    nearest = written(_nearest(pairs), "nearest")
    near = written(near.unionByName(_alike(nearest, first, rows, width, least)), "alike")
    rest = _apart(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), written(simhash.components(near), "roots"))
    return near.unionByName(_alike(written(rest, "rest"), first, rows, width, least))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, distance: int = 3) -> DataFrame:
    """``id_col`` and ``component_id`` (the smallest id reachable over links, its own included) for every row.

    Two texts link if the Jaccard likeness of their shingle sets is ``least``
    or more, or if their SimHash fingerprints (``simhash.near_duplicates``)
    differ in ``distance`` bits or fewer. Null texts and texts without words
    link with each other. Shorter texts than ``width`` words are one shingle.
    Repeated rows give repeated results; an id given to several texts links
    nothing by itself; null ids are below every id. An empty table gives an
    empty result. Further columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(_prints(rows, width, least), "prints")
    first = written(prints.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("share").alias("share")), "distinct")
    prefixes = prints.select("key", "n", "rare", "common").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "rare", "common")])
    near = links(prefixes, first, rows, width, least)
    nodes = written(prints.groupBy("fp", "key").agg(F.min("id").alias("id")), "nodes")
    of_fp = nodes.groupBy("fp").agg(F.min("key").alias("least"))
    named = lambda k: of_fp.select(F.col("fp").alias(k), F.col("least").alias(f"{k}_key"))
    by_print = simhash.links(of_fp.select("fp"), distance).join(named("a"), "a").join(named("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    equal = nodes.join(of_fp, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    roots = written(simhash.components(near.unionByName(by_print).unionByName(equal)), "roots")
    member = nodes.select("key", "id").join(roots, nodes["key"] == roots["node"], "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    member = written(member, "members")
    lowest = member.groupBy("root").agg(F.min("id").alias("component_id"))
    of = member.select("key", "root").distinct().join(lowest, "root").select("key", "component_id")
    return prints.select("id", "key").join(of, "key").select(F.col("id").alias(id_col), "component_id")
