"""The prefix trie of conversations, built as a Patricia tree and expanded.

A conversation is a sequence of turns, a turn the 16 first bytes of the
SHA-256 of its role and text; texts never travel. Equal sequences are one row
with a count. The distinct sequences are sorted over range partitions, so a
first turn that a third of them share spreads over as many tasks as it needs.
One scan of each range keeps the path of the current sequence on a stack and
creates points only where sequences branch or end, with the turns between as
the edge to the point above. A point is complete when the scan leaves it.

Nodes that reach beyond a range begin or end it: they are prefixes of its
first or last sequence. All of those are points, whatever they look like from
inside, and what the ranges know of them is added up by their hash. Every sum
is such that it can be added: of ``n`` sequences of ``w`` words below a point,
``n * w`` goes to one sum, and the words of each node that the sequence before
in the whole order lacks to another; their difference is what sharing saves.

Nodes inside an edge differ from its lower point by the words of the turns
between, so the sums from each turn to the end of the edge expand them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, neighbours, text_id, written

#: Conversations whose ids are so far apart share their first turns with the first of them; a head has fewer turns than ``HEAD``.
BLOCK, HEAD = 20, 4
#: Nodes of a batch that the scan gives out, ids of a piece of text to hash.
BATCH_NODES, PIECE_IDS = 50_000, 50_000
#: Merged points up to which they are broadcast.
BROADCAST_POINTS = 200_000
#: Fixed value: SHA-256 of the empty string.
NOTHING = hashlib.sha256(b"").hexdigest()

POINT = (
    "key binary, parent_key binary, parent_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
    "spoken long, distinct long, edge array<long>, ends string"
)
COLUMNS = [c.split()[0] for c in POINT.split(", ")]


def sequences(turns: DataFrame) -> DataFrame:
    """``conv``, ``seq`` (turn digests) and ``words`` (of each turn) of conversations (``conv_id, turn, role, text``).

    Turns are in the order of ``turn``, null first, equal ones in the order of
    their digests. A null role or text is empty, a null ``conv_id`` an id of
    its own (the least long). All turns of a conversation have to fit one value,
    20 bytes each.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = turns.select(text_id("conv_id").alias("conv"), F.struct("turn", digest.alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")).alias("t"))
    listed = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.transform("t", lambda t: t["d"]).alias("seq"), F.transform("t", lambda t: t["w"]).alias("words"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """``convs`` with heads: the first h turns of the first conversation of each block of ids, then what follows the conversation's own first h; h is the CRC-32 of the id modulo 4."""
    conv = F.col("conv")
    heads = convs.where(conv % BLOCK == 0).select(conv.alias("base"), F.slice("seq", 1, HEAD - 1).alias("head"), F.slice("words", 1, HEAD - 1).alias("head_words"))
    h = (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("int")
    met = convs.withColumns({"base": conv - conv % BLOCK, "h": h}).join(heads, "base", "left")

    def joined(own: str, head: str) -> Column:
        none = F.slice(own, 1, 0)
        return F.concat(F.slice(F.coalesce(F.col(head), none), F.lit(1), F.col("h")), F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0))))

    return met.select("conv", joined("seq", "head").alias("seq"), joined("words", "head_words").alias("words"))


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``key, conv``) in order to rows (``key, first, piece, done``): the hash of a key whose rows all lie between others of this task, else its ids in pieces of text."""
    names, types = ("key", "first", "piece", "done"), (pa.binary(), pa.int64(), pa.string(), pa.bool_())
    key, first, ids, pieces, opening, out = None, None, [], [], True, []

    def close(last: bool) -> list[tuple]:
        if ids:
            pieces.append((key, first, ",".join(ids)))
        if opening or last:
            return [(*p, False) for p in pieces]
        digest = hashlib.sha256()
        for k, p in enumerate(pieces):
            digest.update(("," * (k > 0) + p[2]).encode())
        return [(key, pieces[0][1], digest.hexdigest(), True)]

    for batch in batches:
        for k, conv in zip(batch["key"].to_pylist(), batch["conv"].to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out += close(False)
                    opening = False
                key, first, ids, pieces = k, conv, [], []
            elif len(ids) == PIECE_IDS:
                pieces.append((key, first, ",".join(ids)))
                first, ids = conv, []
            ids.append(str(conv))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if key is not None:
        out += close(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of text in order of (``key, first``) to one hash for each key, piece after piece."""
    key, digest, out = None, None, []
    for batch in batches:
        for k, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(piece.encode())
            else:
                digest.update(("," + piece).encode())
    if key is not None:
        out.append((key, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ("key", "ends"))


def ends_of(members: DataFrame) -> DataFrame:
    """``key`` and ``ends``, the SHA-256 of the ascending ids of its rows (``key, conv``), joined by commas.

    The rows are sorted over range partitions. Only keys that reach beyond a
    range come together, as pieces of text, and are hashed piece by piece.
    """
    runs = written(members.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_hash_runs, "key binary, first long, piece string, done boolean"), "runs")
    open_ = runs.where("not done").repartition("key").sortWithinPartitions("key", "first").select("key", "piece")
    return runs.where("done").select("key", F.col("piece").alias("ends")).unionByName(open_.mapInArrow(_hash_pieces, "key binary, ends string"))


def _prefix(seq: list[bytes], depth: int) -> bytes:
    return hashlib.sha256(b"".join(seq[:depth])).digest()[:16]


class _Point:
    __slots__ = ("depth", "key", "new", "n", "low", "leaves", "children", "spoken", "distinct", "ends", "below")

    def __init__(self, depth: int, key: bytes | None = None, new: bool = True):
        self.depth, self.key, self.new = depth, key, new
        self.n = self.leaves = self.children = self.spoken = self.distinct = 0
        self.low = self.ends = None
        self.below: list[list] = []  # complete rows that wait for the id of this point

    def take(self, n: int, low: int, leaves: int) -> None:
        self.n += n
        self.leaves += leaves
        self.low = low if self.low is None else min(self.low, low)

    def fold(self, child: _Point, total: list[int]) -> None:
        """Adds a complete child; ``total``: words of the path down to each depth."""
        words = total[child.depth] - total[self.depth]
        self.take(child.n, child.low, child.leaves)
        self.spoken += child.spoken + child.n * words
        self.distinct += child.distinct + (words if child.new else 0)
        self.children += child.new

    def row(self, parent_key: bytes | None, edge: list[int]) -> list:
        return [self.key, parent_key, None, self.low, self.depth, self.n, self.children, self.leaves, self.spoken, self.distinct, edge, self.ends]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of the sequences of one range, in order. Rows with a ``key`` are those that other ranges may share."""
    stack: list[_Point] = []
    first = last = None
    total: list[int] = [0]
    out: list[list] = []
    size = 0

    def give(row: list) -> None:
        nonlocal size
        out.append(row)
        size += 1 + len(row[10])

    def settle(p: _Point) -> None:
        """Rows that waited for ``p`` learn its id or its key."""
        for row in p.below:
            row[1], row[2] = (p.key, None) if p.key is not None else (None, p.low)
            give(row)
        p.below = []

    def leave(p: _Point, above: _Point) -> None:
        """``p`` is complete as far as this range goes."""
        settle(p)
        if p.key is not None:
            give(p.row(_prefix(first, p.depth - 1) if p.depth else None, [total[p.depth] - total[max(0, p.depth - 1)]]))
        else:
            row = p.row(None, [total[p.depth] - total[d] for d in range(above.depth, p.depth)])
            if above.key is not None:
                row[1] = above.key
                give(row)
            else:
                above.below.append(row)
        above.fold(p, total)

    def batch_of() -> pa.RecordBatch:
        nonlocal out, size
        types = {"key": pa.binary(), "parent_key": pa.binary(), "edge": pa.list_(pa.int64()), "ends": pa.string()}
        made = pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(COLUMNS, zip(*out, strict=True), strict=True)], COLUMNS)
        out, size = [], 0
        return made

    for batch in batches:
        for r in batch.to_pylist():
            words, shared = r["words"], r["shared"]
            length = len(words)
            if not stack:
                first = r["seq"]
                stack = [_Point(d, _prefix(first, d), d > shared) for d in range(length + 1)]
            else:
                while stack[-1].depth > shared:
                    p = stack.pop()
                    if stack[-1].depth < shared:
                        stack.append(_Point(shared))
                    leave(p, stack[-1])
                stack.append(_Point(length))
            last, total = r["seq"], [0]
            for w in words:
                total.append(total[-1] + w)
            stack[-1].take(r["n"], r["low"], int(r["leaf"]))
            stack[-1].ends = r["ends"]
            if size >= BATCH_NODES:
                yield batch_of()
    while stack:  # the path of the last sequence: each of its nodes is a point
        p, above = stack.pop(), stack[-1] if stack else None
        p.key = _prefix(last, p.depth)
        settle(p)
        up = above.depth if above else -1
        for d in range(p.depth, up, -1):
            words = total[p.depth] - total[d]
            row = p.row(_prefix(last, d - 1) if d else None, [total[d] - total[d - 1] if d else 0])
            if d < p.depth:
                row[0], row[4], row[6], row[11] = _prefix(last, d), d, 1, None
                row[8], row[9] = p.spoken + p.n * words, p.distinct + words
            give(row)
            if size >= BATCH_NODES:
                yield batch_of()
        if above:
            above.fold(p, total)
    if out:
        yield batch_of()


def _common(a: Column, b: Column) -> Column:
    """Turns that two different sequences have in common at their beginnings; -1 if there is no other."""
    return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1, F.lit(-1)).cast("long")


def trie(convs: DataFrame) -> DataFrame:
    """Every node of the trie of ``convs`` (``conv``, ``seq``, ``words``), from the root down; no conversations give no nodes.

    ``conv_id`` is the least member; ``parent_conv_id`` the parent's (null at
    the root); ``saved_tokens`` sums (``n_convs`` - 1) times the words of the
    last turn over the subtree; ``ends_sha256`` hashes the ids of members that end
    here. A conversation without turns is a member of the root alone.
    """
    bounded_batches(convs.sparkSession)
    convs = written(convs.withColumn("key", F.unhex(F.substring(F.sha2(F.array_join(F.transform("seq", F.hex), "").cast("binary"), 256), 1, 32))), "conversations")
    same = convs.groupBy("key", "seq", "words").agg(F.count("*").alias("n"), F.min("conv").alias("low"))
    table = same.join(ends_of(convs.select("key", "conv")), "key").drop("key")
    placed = neighbours(table, [F.col("seq")], ["seq"])
    known = placed.select(
        "seq", "words", "n", "low", "ends", _common(F.col("seq"), F.col("_prev.seq")).alias("shared"),
        (_common(F.col("seq"), F.col("_next.seq")) < F.size("seq")).alias("leaf"),
    )
    points = written(known.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_scan, POINT), "points")
    met = points.where("key is not null").groupBy("key", "parent_key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spoken", "distinct")],
        F.max(F.col("edge")[0]).alias("w"), F.max("ends").alias("ends"),
    )
    met = written(met, "met")
    small = (lambda df: F.broadcast(df)) if met.count() <= BROADCAST_POINTS else (lambda df: df)
    parents = small(met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    shared = met.join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("spoken") - F.col("distinct") + (F.col("n_convs") - 1) * F.col("w")).alias("saved_tokens"), "ends",
    )
    inner = points.where("key is null")
    under = inner.where("parent_key is null").withColumn("above", F.col("parent_id")).unionByName(inner.where("parent_key is not null").join(parents, "parent_key").select(*COLUMNS, "above"))
    each = under.select("*", F.posexplode("edge").alias("k", "to_end"))
    lowest, top = F.col("k") == F.size("edge") - 1, F.col("k") == 0
    expanded = each.select(
        "conv_id", (F.col("depth") - F.size("edge") + 1 + F.col("k")).alias("depth"), F.when(top, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(lowest, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("spoken") - F.col("distinct") + (F.col("n_convs") - 1) * F.col("to_end")).alias("saved_tokens"), F.when(lowest, F.col("ends")).alias("ends"),
    )
    return shared.unionByName(expanded).withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")
