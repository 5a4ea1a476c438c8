"""Hard negatives by exact search in k-means inverted lists.

Rows go to the list of their nearest centroid; a list stores how far its rows
lie from the centroid at most. By Cauchy-Schwarz the inner product of a query
``a`` with any row of a list lies within ``|a| * radius`` of its product with
the centroid. Queries visit the lists by falling upper bound, skip those whose
bounds miss what they search, and stop when the bound of what is left falls
strictly below the score of the last place, so ties are never lost.

A query first searches the best rows of its label, then, for the score of each
of these, the best rows of other labels within the window below it.

Spark deals out the work. Lists are written as blocks of bounded size, dealt
by range, so a list of any length is many rows. Queries are batches. A round
joins each batch with the next lists it needs, four times as many as in the
round before, and streams them past the batch in the order of their bounds;
what the batch has found is written, and the next round starts from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, bounded_sample, text_id, written

#: Rows to fit the centroids on, centroids and rounds of fitting at most.
SAMPLE_ROWS, MOST_LISTS, FIT_ROUNDS = 16_384, 1024, 8
#: Rows of a block and queries of a batch at most; batches as long as they are smaller.
BLOCK_ROWS, BATCH_QUERIES, BATCHES = 1024, 512, 24
#: Lists of the first round, and how many times more each further round takes.
FIRST_LISTS, WIDER = 4, 4
#: Whole numbers below this are exact in a double.
EXACT = 2**53

BLOCK = "cluster int, block string, radius double, ids binary, places binary, labels binary, vectors binary"


def whole_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> Column:
    """The vector as whole numbers, ``floor(scale * x)`` of each component; null if it, or a component, is null or not finite."""
    v = F.col(f"`{vector}`")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(usable, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _record(names: tuple, types: tuple, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; short vectors are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out, at = np.zeros((len(sizes), dim), np.int64), 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def fit(sample: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows drawn at random; a centroid without rows stays where it is."""
    draw = np.random.default_rng(seed)
    x = sample.astype(float)
    centroids = x[np.sort(draw.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(FIT_ROUNDS):
        near = _nearest(x, centroids)[0]
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid and the distance to it, a thousand rows at a time."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    square = (centroids**2).sum(axis=1)
    for i in range(0, len(x), 1000):
        part = x[i : i + 1000].astype(float)
        near[i : i + 1000] = k = (square - 2 * (part @ centroids.T)).argmin(axis=1)
        far[i : i + 1000] = np.sqrt(((part - centroids[k]) ** 2).sum(axis=1))
    return near, far


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, far = _nearest(_matrix(b["v"], centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(far), *b.columns], ["cluster", "far", *b.schema.names])

    return run


def _blocks(dim: int, kind: str):
    """Rows in order of their list to blocks of rows of one list."""
    names, types = zip(*[(c.split()[0], {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCK.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the list that is open

        def block() -> pa.RecordBatch:
            cluster, far, ids, places, labels, v = zip(*held, strict=True)
            row = (cluster[0], f"{places[0]:x}", max(far), np.array(ids).tobytes(), np.array(places).tobytes(), np.array(labels).tobytes(), np.stack(v).astype(kind).tobytes())
            held.clear()
            return _record(names, types, [row])

        for b in batches:
            columns = [b[c].to_pylist() for c in ("cluster", "far", "id", "place", "label")]
            for row in zip(*columns, _matrix(b["v"], dim), strict=True):
                if held and (held[0][0] != row[0] or len(held) == BLOCK_ROWS):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return run


class Batch:
    """Queries of one batch and what they have found: ``best`` rows of their label, then for each of the scores of these the ``hard`` rows of its window."""

    def __init__(self, keys: list[bytes], labels: list[int], vectors: np.ndarray, lists: int, search: Search):
        self.keys, self.labels, self.a = keys, np.array(labels), vectors
        self.best: list[list[tuple]] = [[] for _ in keys]
        self.windows: list[list[int]] | None = None
        self.hard: list[dict[int, list[tuple]]] = [{} for _ in keys]
        self.seen, self.take, self.done = np.zeros(lists, bool), FIRST_LISTS, False
        self.aim(search)

    def aim(self, search: Search) -> None:
        """The least score that still matters to each query, and the largest."""
        n = len(self.keys)
        self.least, self.most = np.full(n, -np.inf), np.full(n, np.inf)
        for q in range(n):
            if self.windows is None:
                if len(self.best[q]) > search.positives:
                    self.least[q] = -self.best[q][-1][0]
            elif self.windows[q]:
                self.least[q] = min(search.floor(p) if len(h := self.hard[q][p]) < search.negatives else -h[-1][0] for p in self.windows[q])
                self.most[q] = self.windows[q][0]
            else:
                self.least[q], self.most[q] = np.inf, -np.inf

    def wanted(self, search: Search) -> np.ndarray:
        """The lists to visit from here on, by falling upper bound."""
        at = self.a.astype(float) @ search.centroids.T
        reach = np.sqrt((self.a.astype(float) ** 2).sum(axis=1))[:, None] * search.radii
        slack = 1e-9 * (np.abs(at) + reach) + 1e-6
        upper, lower = at + reach + slack, at - reach - slack
        need = (upper >= self.least[:, None]) & (lower <= self.most[:, None])
        top = np.where(need, upper, -np.inf).max(axis=0)
        order = np.argsort(-top, kind="stable")
        return order[np.isfinite(top[order]) & ~self.seen[order] & search.there[order]]

    def settle(self, search: Search) -> None:
        """Goes on to the windows where the best rows are known, and ends where these are."""
        if not self.done and not len(self.wanted(search)):
            if self.windows is None:
                self.windows = [sorted({-s for s, *_ in rows if -s >= search.floor(-s)}, reverse=True) for rows in self.best]
                self.hard = [{p: [] for p in ps} for ps in self.windows]
                self.seen[:], self.take = False, FIRST_LISTS
                self.aim(search)
                self.settle(search)
            else:
                self.done = True

    def meet(self, cluster: int, ids: np.ndarray, places: np.ndarray, labels: np.ndarray, vectors: np.ndarray, search: Search) -> None:
        """Visits one block."""
        scores = search.product(self.a, vectors)
        inside = (scores >= self.least[:, None]) & (scores <= self.most[:, None])
        inside &= (labels[None, :] == self.labels[:, None]) == (self.windows is None)
        for q in np.flatnonzero(inside.any(axis=1)):
            at = np.flatnonzero(inside[q])
            order = at[np.lexsort((places[at], ids[at], -scores[q, at]))]
            s = scores[q, order].astype(np.int64)
            if self.windows is None:
                keep = search.positives + 1
                self.best[q] = sorted([*self.best[q], *zip((-s[:keep]).tolist(), ids[order[:keep]].tolist(), places[order[:keep]].tolist(), strict=True)])[:keep]
                continue
            for p in self.windows[q]:
                first, end = np.searchsorted(-s, (-p, -search.floor(p)), side="left")[0], np.searchsorted(-s, -search.floor(p), side="right")
                end = min(end, first + search.negatives)
                if end > first:
                    own = order[first:end]
                    self.hard[q][p] = sorted([*self.hard[q][p], *zip((-s[first:end]).tolist(), ids[own].tolist(), places[own].tolist(), strict=True)])[: search.negatives]
        self.seen[cluster] = True
        self.aim(search)


class Search:
    """What all batches know: the centroids and radii of the lists, and what is asked for."""

    def __init__(self, centroids: np.ndarray, kind: str, exact: bool, positives: int, negatives: int, low: int, high: int):
        self.centroids, self.kind, self.exact = centroids, kind, exact
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high
        self.radii, self.there = np.zeros(len(centroids)), np.zeros(len(centroids), bool)

    def floor(self, score: int) -> int:
        """The least score of the window below ``score``."""
        return -(-self.low * score // self.high)

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(float) @ b.astype(float).T if self.exact else a.astype(np.int64) @ b.astype(np.int64).T


def _batches_of(search: Search, size: int):
    """Queries in order of their list to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            keys, labels, vectors = zip(*held, strict=True)
            made = Batch(list(keys), list(labels), np.stack(vectors), len(search.centroids), search)
            made.settle(search)
            held.clear()
            return _record(("batch", "state", "done"), (pa.binary(), pa.binary(), pa.bool_()), [(keys[0], pickle.dumps(made), made.done)])

        for b in batches:
            for row in zip(b["key"].to_pylist(), b["label"].to_pylist(), _matrix(b["v"], search.centroids.shape[1]), strict=True):
                held.append(row)
                if len(held) == size:
                    yield batch()
        if held:
            yield batch()

    return run


def _next_lists(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, state in zip(b["batch"].to_pylist(), b["state"].to_pylist(), strict=True):
                made: Batch = pickle.loads(state)
                rows = [(key, rank, int(c)) for rank, c in enumerate(made.wanted(search)[: made.take])]
                if rows:
                    yield _record(("batch", "rank", "cluster"), (pa.binary(), pa.int32(), pa.int32()), rows)

    return run


def _visit(search: Search):
    """Rows in order: the state of a batch, then the blocks it asked for. Lists that nobody needs any more when their turn comes are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, cluster, need = None, None, None, False

        def end() -> pa.RecordBatch:
            made.take *= WIDER
            made.settle(search)
            return _record(("batch", "state", "done"), (pa.binary(), pa.binary(), pa.bool_()), [(key, pickle.dumps(made), made.done)])

        for b in batches:
            for r in b.to_pylist():
                if r["state"] is not None:
                    if made is not None:
                        yield end()
                    key, made, cluster = r["batch"], pickle.loads(r["state"]), None
                    continue
                if r["cluster"] != cluster:
                    cluster = r["cluster"]
                    need = cluster in made.wanted(search)
                if need:
                    ids, places, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "places", "labels"))
                    made.meet(cluster, ids, places, labels, np.frombuffer(r["vectors"], search.kind).reshape(len(ids), -1), search)
        if made is not None:
            yield end()

    return run


ROW = "score long, id long, place long"
FOUND = f"key binary, best array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>, windows array<struct<score:long,hard:array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = pa.list_(pa.struct([(n, pa.int64()) for n in ("score", "id", "place")]))
    window = pa.list_(pa.struct([("score", pa.int64()), ("hard", row)]))
    listed = lambda rows: [{"score": -s, "id": i, "place": p} for s, i, p in rows]
    for b in batches:
        for state in b["state"].to_pylist():
            made: Batch = pickle.loads(state)
            rows = [(k, listed(best), [{"score": p, "hard": listed(h)} for p, h in hard.items()]) for k, best, hard in zip(made.keys, made.best, made.hard, strict=True)]
            yield _record(("key", "best", "windows"), (pa.binary(), row, window), rows)


def mine(items: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds.

    ``items``: ``id``, ``label`` and ``v``, a vector of whole numbers; rows with
    a null label or vector take no part. Scores are inner products, short
    vectors filled with zeros; they have to fit a long. The positives of an
    anchor are its best other rows of the same label. For each, its negatives
    are the best rows of other labels with ``low * positive <= high * score
    <= high * positive`` (nothing for scores below zero). Equal scores come by
    the smaller id, a null id being the least long. Repeated rows each count,
    and an anchor is no positive of itself, though a repeat of it is. No rows,
    or no anchors, give no rows.
    """
    spark = items.sparkSession
    bounded_batches(spark)
    own = items.where("label is not null and v is not null").select(text_id("id").alias("id"), F.col("label").cast("long").alias("label"), "v", F.coalesce(anchors, F.lit(False)).alias("anchor"))
    key = F.unhex(F.substring(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: x.cast("string"))).cast("binary"), 256), 1, 32))
    rows = written(own.withColumns({"place": F.monotonically_increasing_id(), "key": key}), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("square"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    if size.n and size.square >= 2.0**63:
        raise ValueError("the inner products of these vectors do not fit a long")
    # Of equal vectors of one label only the first can be among the best: each task keeps as many before they shuffle.
    first = Window.partitionBy("key").orderBy("id", "place")
    kept = written(rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= max(positives + 1, negatives)).select("id", "place", "label", "v"), "kept")
    queries = rows.where("anchor").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    n, dim = kept.count(), max(1, size.dim or 0)
    asked = queries.count() if n else 0
    sample = [r.v for r in bounded_sample(kept, "place", SAMPLE_ROWS).select("v").collect()]
    matrix = _matrix(pa.array(sample, pa.list_(pa.int64())), dim) if sample else np.zeros((1, dim), np.int64)
    most = size.most or 0
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    search = Search(fit(matrix, max(1, min(MOST_LISTS, round(n**0.5)))), kind, (size.square or 0) < EXACT, positives, negatives, low, high)
    placed = kept.mapInArrow(_assigned(search.centroids), "cluster int, far double, id long, place long, label long, v array<long>")
    blocks = written(placed.repartitionByRange("cluster", "far", "place").sortWithinPartitions("cluster", "far", "place").mapInArrow(_blocks(dim, kind), BLOCK), "blocks")
    for r in blocks.groupBy("cluster").agg(F.max("radius").alias("radius")).collect():  # one row for each list
        search.radii[r.cluster], search.there[r.cluster] = r.radius * (1 + 1e-9), True
    near = queries.mapInArrow(_assigned(search.centroids), "cluster int, far double, key binary, label long, v array<long>")
    per = max(1, min(BATCH_QUERIES, -(-asked // BATCHES)))
    kinds = "batch binary, state binary, done boolean"
    states = written(near.repartitionByRange("cluster", "key").sortWithinPartitions("cluster", "key").mapInArrow(_batches_of(search, per), kinds), "batches")
    ended = [states.where("done")]
    while not (live := states.where("not done")).isEmpty():
        pairs = live.select("batch", "state").mapInArrow(_next_lists(search), "batch binary, rank int, cluster int")
        sent = pairs.join(blocks.drop("radius"), "cluster").withColumn("state", F.lit(None).cast("binary"))
        heads = live.select("batch", F.lit(-1).alias("rank"), "state")
        both = heads.unionByName(sent, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "rank", "block")
        states = written(both.mapInArrow(_visit(search), kinds), "batches")
        ended.append(states.where("done"))
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    results = found.select("state").mapInArrow(_found, FOUND)
    met = rows.where("anchor").select("id", "place", "key").join(results, "key")
    others = met.select("id", F.slice(F.filter("best", lambda p: p["place"] != F.col("place")), 1, positives).alias("best"), "windows")
    each = others.select("id", F.explode("best").alias("p"), "windows")
    hard = F.flatten(F.transform(F.filter("windows", lambda w: w["score"] == F.col("p.score")), lambda w: w["hard"]))
    out = each.select("id", "p", F.posexplode(hard).alias("k", "n"))
    return out.select(
        F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("k") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
