"""Exact duplicates by two passes with a Bloom filter, in DataFrame functions alone.

Pass one sets, for every text, a few bits of a filter and counts how many rows
set each; the bits that two rows or more set are the filter of possibly
repeated hashes. Pass two asks it about every row. A row with one bit that no
other row set is the only one of its text and passes straight through. The
others, repeats and a few false alarms, shuffle by the whole SHA-256 of their
text, which alone decides.

A filter is a table of blocks of 64 Ki bits. It is sized by the number of
rows and never larger than ``max_bits``, so it can be broadcast. Beyond that
number of rows the hashes are cut into slices, each with a filter of its own,
one after the other. No text travels, only hashes and ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import new_path, whole_row, written

#: Bits of a filter for each row, bits of a block, bits that a row sets in its block.
BITS_A_ROW, BLOCK_BITS, PROBES = 16, 1 << 16, 2
#: Bits of a filter at most: 32 MB to broadcast.
MAX_BITS = 1 << 28
#: Groups with more than one in so many of the rows to compare are heavy; there are at most as many.
HEAVY = 1000


def sha(text: Column) -> Column:
    """The SHA-256 of a text, as bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _blocks(rows: int, max_bits: int) -> int:
    return max(1, min(-(-rows * BITS_A_ROW // BLOCK_BITS), max_bits // BLOCK_BITS))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))


def _probes(h: Column) -> list[Column]:
    """The bits of its block that a hash sets."""
    return [F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)]


def bloom(hashes: DataFrame, blocks: int, least: int) -> DataFrame:
    """The filter (``_block``, ``_words``) of the longs ``h``: the bits that ``least`` rows or more set.

    Every bit is counted within the tasks first, so one hash of any number of
    rows is one row of each task in the shuffle.
    """
    spark = hashes.sparkSession
    h = F.col("h")
    bits = hashes.select(F.explode(F.array(*[_block(h, blocks) * BLOCK_BITS + p for p in _probes(h)])).alias("bit"))
    often = bits.groupBy("bit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = often.select(F.shiftright("bit", 6).alias("word"), place.alias("bits"))
    none = spark.range(blocks * (BLOCK_BITS // 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = words.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    a_block = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    return whole.groupBy(F.floor(F.col("word") / (BLOCK_BITS // 64)).cast("long").alias("_block")).agg(a_block.alias("_words"))


def probed(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with ``h``) and ``_again``: false only where the filter has not all bits of the hash."""
    has = [F.bit_get(F.get("_words", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _probes(F.col("h"))]
    test = has[0]
    for x in has[1:]:
        test = test & x
    met = rows.withColumn("_block", _block(F.col("h"), blocks)).join(F.broadcast(filter_), "_block", "left")
    return met.withColumn("_again", F.coalesce(test, F.lit(False))).drop("_block", "_words")


def _marked(hashed: DataFrame, max_bits: int) -> DataFrame:
    """``hashed`` with ``_again``, slice by slice."""
    spark, path, rows = hashed.sparkSession, new_path(hashed.sparkSession, "marked"), hashed.count()
    slices = max(1, -(-rows * BITS_A_ROW // max_bits))
    for k in range(slices):
        part = hashed.where(F.pmod(F.xxhash64("h"), F.lit(slices)) == k) if slices > 1 else hashed
        blocks = _blocks(-(-rows // slices), max_bits)
        found = written(bloom(part.select("h"), blocks, 2), "filter")
        probed(part, found, blocks).write.mode("append").parquet(path)
    return spark.read.schema(hashed.schema.add("_again", "boolean")).parquet(path)


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: the id under its name, ``keep_id``, ``group_size``, ``kept`` and ``sha``.

    Rows form a group when their texts are equal, character for character;
    null is an empty text. The row with the largest id is kept (a null id is
    below all others), and of rows that share that id too exactly one, any.
    Nothing else of ``docs`` is read, so other columns may have any name. No
    rows give no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), sha(F.col(f"`{text_col}`")).alias("sha"))
    hashed = written(own.withColumns({"h": F.xxhash64("sha"), "row": F.monotonically_increasing_id()}), "hashed")
    marked = _marked(hashed, max_bits)
    alone = marked.where("not _again").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = marked.where("_again").select("id", "sha", "row")
    groups = written(again.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep")), "groups")
    heavy = F.col("group_size") * HEAVY > again.count()
    met = again.join(F.broadcast(groups.where(heavy)), "sha", "left")
    rest = met.where("keep is null").select("id", "sha", "row").join(groups.where(~heavy), "sha")
    same = met.where("keep is not null").unionByName(rest)
    out = alone.unionByName(same.select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "sha")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without repeats, all columns: of the rows of a text the one with the largest id, once.

    Rows whose hash the filter of repeated texts lacks pass straight through.
    The others are reduced to one for each text in each task before they
    shuffle. Ids, nulls and ties count as in ``groups_of``.
    """
    found = groups_of(docs, id_col, text_col, max_bits)
    repeated = written(found.where("kept and group_size > 1").select(F.xxhash64("sha").alias("h")), "repeated")
    blocks = _blocks(repeated.count(), max_bits)
    own = sha(F.col("doc").getField(text_col))
    rows = docs.select(whole_row(docs).alias("doc")).withColumn("sha", own).withColumn("h", F.xxhash64("sha"))
    asked = probed(rows, written(bloom(repeated, blocks, 1), "filter"), blocks)
    best = asked.where("_again").groupBy("sha").agg(F.max_by("doc", F.struct(F.col("doc").getField(id_col), F.lit(0))).alias("doc"))
    return asked.where("not _again").select("doc").unionByName(best.select("doc")).select("doc.*")
