"""Document fingerprints from closed syncmers, with DataFrame functions only.

The symbols of a text are its words where words stand between spaces, and its
code points in scripts that are written without spaces and in runs of more
than ``LONG`` characters; so a symbol never depends on where such a run begins.
A k-mer is five symbols in a row, and its inner substrings (s-mers) are two.
A k-mer is a closed syncmer if the smallest hash of its four s-mers is that of
the first or of the last one. That depends on the k-mer alone, so equal
passages have equal anchors wherever they stand and whatever stands before
them; half of all k-mers are anchors, and two neighbours are never further
apart than three symbols.

A fingerprint is all anchors of a text by position, none sampled or cut.
Likenesses come from positional matching: anchors of equal hash are paired, and
a pair counts where the pair before or behind it lies on the same diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import NULL_ID, text_id

#: A run of more characters is read by code points.
LONG = 24
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS = 16
# Scripts that are written without spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_SYMBOL = rf"([{UNSPACED}]|(?<![^\s{UNSPACED}])[^\s{UNSPACED}]{{1,{LONG}}}+(?![^\s{UNSPACED}])|\S)"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def symbols(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(1))


def anchors(text: Column) -> Column:
    """array<long>: the closed syncmers by position, each the symbol position (from 0) times 2^32 plus a hash of 32 bits.

    A text of one to four symbols, or whose k-mers are no syncmers, has one
    anchor, of the whole; null and texts without symbols have none.
    """

    def anchor(pos: Column, h: Column) -> Column:
        return F.shiftleft(pos.cast("long"), 32).bitwiseOR(F.shiftrightunsigned(h, 32))

    def smers(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1)))

    def chosen(g: Column) -> Column:
        at = lambda i: F.element_at(g, i)
        edge = F.filter(F.sequence(F.lit(1), F.size(g) - 3), lambda i: F.least(at(i), at(i + 3)) <= F.least(at(i + 1), at(i + 2)))
        return F.transform(edge, lambda i: anchor(i - 1, F.xxhash64(at(i), at(i + 2), at(i + 3))))

    def of(h: Column) -> Column:
        whole = F.transform(F.filter(F.array(h), lambda x: F.size(x) > 0), lambda x: anchor(F.lit(0), F.xxhash64(x)))
        return F.when(F.size(h) < 5, whole).otherwise(_let(_let(smers(h), chosen), lambda found: F.when(F.size(found) > 0, found).otherwise(whole)))

    return _let(F.transform(symbols(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)), of)


def hash_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << 32) - 1))


def position_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def fingerprint(anchored: Column) -> Column:
    """The anchors as a string: ``position:hash`` (decimal, hexadecimal), joined by commas; empty without anchors. Equal texts have equal ones."""
    return F.array_join(F.transform(anchored, lambda a: F.concat(position_of(a), F.lit(":"), F.lower(F.hex(hash_of(a))))), ",")


def firsts(anchored: Column) -> Column:
    """map<long, long>: the hashes of anchors, and the position where each stands first."""
    turned = F.array_sort(F.transform(anchored, lambda a: F.shiftleft(hash_of(a), 31).bitwiseOR(position_of(a))))
    hashed = lambda x: F.shiftrightunsigned(x, 31)
    alone = lambda s: F.filter(s, lambda x, i: (i == 0) | (hashed(F.get(s, i - 1)) != hashed(x)))
    kept = lambda s: F.map_from_arrays(F.transform(s, hashed), F.transform(s, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1))))
    return _let(turned, lambda s: _let(alone(s), kept))


def matches(a: Column, b: Column) -> Column:
    """array<struct<left_pos, right_pos>>: anchors that two texts (as ``firsts``) have in common, where they stand first, by left position."""
    met = F.map_values(F.map_zip_with(a, b, lambda h, x, y: F.struct(x.alias("left_pos"), y.alias("right_pos"))))
    return F.array_sort(F.filter(met, lambda m: m["left_pos"].isNotNull() & m["right_pos"].isNotNull()))


def supported(found: Column) -> Column:
    """Those of the ``matches`` with a neighbour among them on the same diagonal."""
    diagonal = lambda m: m["left_pos"] - m["right_pos"]
    same = lambda s, m, i: F.coalesce((i >= 0) & (diagonal(F.get(s, i)) == diagonal(m)), F.lit(False))
    return _let(found, lambda s: F.filter(s, lambda m, i: same(s, m, i - 1) | same(s, m, i + 1)))


def likeness(a: Column, b: Column) -> Column:
    """How alike two texts are, 0 to 1, by their anchors (as ``firsts``): supported matches over the distinct hashes of both.

    1 for equal anchors (of two texts without any, too). A match without
    support, such as the only one of two texts, is chance and counts nothing.
    """

    def shared(x: Column) -> Column:
        both = F.size(supported(matches(x["a"], x["b"])))
        return both / F.greatest(F.size(x["a"]) + F.size(x["b"]) - both, F.lit(1))

    equal = F.map_entries(a) == F.map_entries(b)
    return F.when(equal, F.lit(1.0)).otherwise(_let(F.struct(a.alias("a"), b.alias("b")), shared))


def positional_matches(pairs: DataFrame, left: str = "left_text", right: str = "right_text") -> DataFrame:
    """``pairs`` with ``matches``: the anchors that both texts have, by left position.

    Null texts have no anchors. Every row is kept; ``matches`` replaces a
    column of that name.
    """
    of = lambda c: firsts(anchors(F.col(c)))
    return pairs.withColumn("matches", _let(F.struct(of(left).alias("a"), of(right).alias("b")), lambda x: matches(x["a"], x["b"])))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", derived: dict[str, Column] | None = None) -> DataFrame:
    """``id`` (long), ``text``, ``n_chars``, ``next_start``, the columns ``derived`` (expressions over ``text``), and the next document's as ``next_<name>``.

    The next document is the one with the next lower id, after the lowest the
    highest. ``next_start`` is the first floor(n_chars / 3) code points of its
    text. Texts travel once, into buckets of neighbouring ids, with the last
    row of each bucket to the next one too; a window inside the bucket hands
    every row its neighbour.

    Null ids count as the lowest id, and an id that is no number as a hash of
    it. Where rows share an id, each has the same next document, and as a
    next document the least of their texts stands for them. Null texts are
    empty. An empty table gives no rows. Further columns are not looked at.
    """
    spark, derived = docs.sparkSession, derived or {}
    rows = docs.select(text_id(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # As many buckets as the cluster has use for; their bounds and greatest ids are that many numbers.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = BUCKETS * partitions
    ids = rows.select("id")
    bounds = ids.agg(F.percentile_approx("id", [k / count for k in range(1, count)], F.lit(4 * count))).first()[0] or []
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("id")))
    greatest = [(r["bucket"], r["id"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("id")).orderBy("bucket").collect()]
    carried = [(i, b) for (_, i), (b, _) in zip(greatest, greatest[1:] + greatest[:1])]
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(b).alias("bucket")) for i, b in carried]).cast("array<struct<id:bigint,bucket:int>>")
    extra = spark.range(1).select(F.inline(listed).alias("id", "bucket"))
    dealt = rows.withColumns({"bucket": bucket, "own": F.lit(True)})
    dealt = dealt.unionByName(rows.join(F.broadcast(extra), "id").withColumn("own", F.lit(False)))
    order = [F.col("bucket"), F.col("own"), F.col("id"), F.col("text").desc()]
    local = dealt.repartition(partitions, "bucket").sortWithinPartitions(*order).select("*", *[c.alias(n) for n, c in derived.items()])
    part = Window.partitionBy("bucket").orderBy(*order[1:])
    before = F.struct("text", *derived)
    changes = F.when(F.lag("own").over(part).isNotNull() & (F.lag("own").over(part) != F.col("own")) | (F.lag("id").over(part) != F.col("id")), F.lag(before).over(part))
    nearby = local.withColumn("_change", changes).withColumn("_next", F.last("_change", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    return nearby.where("own").select(
        F.nullif("id", F.lit(NULL_ID)).alias("id"), "text", F.length("text").alias("n_chars"), F.expr("left(_next.text, length(text) div 3)").alias("next_start"),
        *derived, *[F.col(f"_next.{n}").alias(f"next_{n}") for n in derived],
    )
