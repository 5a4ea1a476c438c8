"""What two series share: stretches of equal frames at any offset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ranks import top_k
from tessella.operators.vectors import dot, normalize
from tessella.session import written

#: Indexes of a series that one block spans; two blocks are compared at once.
BLOCK = 512
#: Bytes after which a batch of tiles for a Python worker is closed.
BATCH_BYTES = 2 << 20
#: Hits of tiles after which a worker makes runs of them.
HELD = 1 << 18


def _units(frames: DataFrame) -> DataFrame:
    """``series, i, v`` with unit vectors, without silence."""
    return frames.where(F.exists("v", lambda x: x != 0)).select("series", "i", normalize(F.col("v")).alias("v"))


def similar_frames(frames: DataFrame, pairs: DataFrame, similarity: float, cells: int = 2) -> DataFrame:
    """``a, b, i, j`` of the frames of each pair of series whose cosine is ``similarity`` or more.

    ``frames``: ``series, i, v``; zero and null vectors are silence and like
    nothing. Unit vectors with a cosine of c lie sqrt(2 - 2c) apart at most,
    and no further in any one component. So in the ``cells`` components that
    vary most, cut into cells of that width, the cells of a frame and of its
    likes are the same or neighbours: one side goes to its own cell, the
    other to the cells around it, and the join is by cell.
    """
    unit = _units(frames)
    varying = unit.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("var")).orderBy(F.col("var").desc(), "d").limit(cells)
    axes = [r.d for r in varying.collect()]  # one row for each component
    width = F.lit(max(1e-6, (2 - 2 * min(1.0, similarity)) ** 0.5 + 1e-9))
    cell = lambda d: F.floor(F.col("v")[d] / width)
    own = [cell(d).alias(f"c{k}") for k, d in enumerate(axes)]
    right = pairs.join(unit.withColumnRenamed("series", "b"), "b").select("a", "b", F.col("i").alias("j"), F.col("v").alias("w"), *own)
    left = pairs.join(unit.withColumnRenamed("series", "a"), "a").select("a", "b", "i", "v", *own)
    for k in range(len(axes)):
        left = left.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + s for s in (-1, 0, 1)])))
    return left.join(right, ["a", "b", *[f"c{k}" for k in range(len(axes))]]).where(dot(F.col("v"), F.col("w")) >= similarity).select("a", "b", "i", "j")


def _blocks(frames: DataFrame, block: int) -> DataFrame:
    """Frames by ``series`` and ``block`` of that many indexes as one list, with the ``least`` and ``most`` index of the series."""
    w = Window.partitionBy("series")
    known = _units(frames).where("i is not null").withColumns({"least": F.min("i").over(w), "most": F.max("i").over(w)})
    return known.groupBy("series", F.floor(F.col("i") / block).alias("block"), "least", "most").agg(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "v")).alias("frames"))


def _unpacked(frames: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block: indexes, places and sizes of its vectors, and the values they are in."""
    i, v = frames.flatten().flatten()
    i, sizes, values = i.to_numpy(), v.value_lengths().to_numpy(), v.flatten().to_numpy(zero_copy_only=False)
    places, ends = np.cumsum(sizes) - sizes, np.cumsum(frames.value_lengths().to_numpy())
    return ((i[x:y], places[x:y], sizes[x:y], values) for x, y in zip(np.append(0, ends[:-1]), ends))


def _hits(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``k, i`` of the frames of two blocks that are alike; vectors of different sizes never are."""
    for size in {*a[2].tolist()} & {*b[2].tolist()}:
        (i, v), (j, w) = ((x[0][own], x[3][x[1][own] + np.arange(size)[:, None]]) for x in (a, b) for own in [x[2] == size])
        alike = np.zeros((len(i), len(j)))
        for x, y in zip(v, w):  # one after the other, as ``dot`` adds, so that no digit differs
            alike += x[:, None] * y
        at, to = np.nonzero(alike >= similarity)
        yield j[to] - i[at], i[at]


def _stretches(hits: np.ndarray, max_gap: int) -> np.ndarray:
    """From hits (rows: tile, k, i) the runs on each diagonal of each tile (rows: tile, k, first, last, n)."""
    tile, k, i = hits[:, np.lexsort(hits[::-1])]
    at = np.flatnonzero((np.diff(tile, prepend=-1) != 0) | (np.diff(k, prepend=0) != 0) | (np.diff(i, prepend=0) > max_gap + 1))
    ends = np.append(at, len(i))[1:]
    return np.stack([tile[at], k[at], i[at], i[ends - 1], ends - at])


def _may_count(runs: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, least: int, max_gap: int) -> np.ndarray:
    """Whether runs are long enough, or may go on in the next tile of their diagonal. ``a``, ``b``: block, least and most index of each tile's series."""
    tile, k, first, last, _ = runs
    (at, low, high), (to, low_b, high_b) = a[:, tile], b[:, tile]
    begin, end = np.maximum(at * block, to * block - k), np.minimum(at * block, to * block - k) + block - 1
    before = (np.maximum(low, low_b - k) < begin) & (first - begin <= max_gap)
    after = (np.minimum(high, high_b - k) > end) & (end - last <= max_gap)
    return (last - first + 1 >= least) | before | after


def _partial_runs(similarity: float, block: int, least: int, max_gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles to those of their runs that ``_may_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.stack([batch.column(f"{c}_{side}").to_numpy() for c in ("block", "least", "most")]) for side in "ab")
            held, size, found = [], 0, [np.zeros((5, 0), np.int64)]
            for tile, blocks in enumerate(zip(_unpacked(batch.column("frames_a")), _unpacked(batch.column("frames_b")))):
                for k, i in _hits(*blocks, similarity):
                    held.append(np.stack([np.full(len(i), tile), k, i]))
                    size += len(i)
                if held and (size > HELD or tile == batch.num_rows - 1):
                    runs = _stretches(np.concatenate(held, axis=1), max_gap)
                    found.append(runs[:, _may_count(runs, a, b, block, least, max_gap)])
                    held, size = [], 0
            tile, *rest = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(tile)) for c in ("a", "b")], *map(pa.array, rest)], ["a", "b", "k", "first", "last", "n"])

    return run


def _joined(parts: DataFrame, by: list[str], max_gap: int) -> DataFrame:
    """Partial runs of each diagonal as whole ones."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("_new", F.when(F.col("first") - reached > max_gap + 1, 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_run")


def shared_segments(frames: DataFrame, pairs: DataFrame, similarity: float, least: int, most: int, max_gap: int, coverage: float = 0.6, block: int = BLOCK) -> DataFrame:
    """The longest stretch that each pair of series shares at one offset: ``start_a, start_b, length`` in frames and ``coverage``.

    On each diagonal the longest run of like frames counts (the first of
    several), with gaps of up to ``max_gap`` frames bridged. It has to have
    between ``least`` and ``most`` frames and ``coverage`` of them alike. Of
    several diagonals the longest wins, then the lowest offset. Pairs that
    share nothing have no row. Silence and frames with a null or NaN are like
    nothing.

    All frames of a pair are compared, a block of ``block`` indexes of one
    series with one of the other. Of such a tile only runs are dealt out, and
    of these those that are long enough or may go on in the next tile; single
    frames and hits are not.
    """
    frames.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    blocks = written(_blocks(frames, block), "blocks")
    side = lambda s: blocks.select(F.col("series").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns[1:]]).hint("merge")
    tiles = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    longs = [T.StructField(c, T.LongType()) for c in ("k", "first", "last", "n")]
    parts = tiles.mapInArrow(_partial_runs(similarity, block, least, max_gap), T.StructType([pairs.schema["a"], pairs.schema["b"], *longs]))
    by = ["a", "b", "k"]
    r = _joined(parts, by, max_gap).withColumn("length", F.col("last") - F.col("first") + 1)
    longest = top_k(r, 1, by, F.col("length").desc(), F.col("first"))
    fit = longest.where(F.col("length").between(least, most) & (F.col("n") / F.col("length") >= coverage))
    best = top_k(fit, 1, ["a", "b"], F.col("length").desc(), F.col("k"))
    return best.select("a", "b", F.col("first").alias("start_a"), (F.col("first") + F.col("k")).alias("start_b"), "length", (F.col("n") / F.col("length")).alias("coverage"))
