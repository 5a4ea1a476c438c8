"""Benchmark decontamination by a hash set of test n-grams, with DataFrame functions only.

The benchmark's windows of ``n`` normalised words form a set, indexed by a bit
map of their hashes of fixed size. The window hashes of a document are looked
up in the bit map inside its own row; the few windows that pass go on as rows
of text and are verified against the set itself, word for word. Documents
whose words are all clean cost one scan and no shuffle of texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_id, written

#: Bits of the map of window hashes (a power of two): 256 kB, whatever the benchmark.
MAP_BITS = 1 << 21
#: Sets of more windows than this are not broadcast but joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
_WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters and digits (all characters above ASCII count), A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORDS), F.lit(1))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _window_hash(hashes: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.slice(hashes, start, n))


def windows(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``size``, ``window`` (words joined by spaces), ``item`` (as string). An item of fewer words than ``n`` is one window; one of none has none."""
    w = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    at = w.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    return at.select("size", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("window"), "item").distinct()


def _bit_map(wins: DataFrame) -> DataFrame:
    """One row with ``map``: array<long> of MAP_BITS bits, set at the hashes of all windows."""
    hashed = wins.select(_window_hash(F.transform(F.split("window", " "), lambda x: F.xxhash64(x)), F.lit(1), 64).bitwiseAND(F.lit(MAP_BITS - 1)).alias("h"))
    filled = hashed.groupBy(F.shiftright("h", 6).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    every = wins.sparkSession.range(0, MAP_BITS // 64, 1, 1).select(F.col("id").cast("int").alias("slot"))
    slots = every.join(filled, "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).alias("bits"))
    return slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bits"))), lambda s: s["bits"]).alias("map"))


def _shipped_map(wins: DataFrame) -> Column:
    """The bit map as a constant: a session variable, which plans take in as a literal."""
    spark, name = wins.sparkSession, "tessella_" + uuid.uuid4().hex
    _bit_map(wins).createOrReplaceTempView(name + "_view")
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<BIGINT>")
    spark.sql(f"SET VARIABLE {name} = (SELECT map FROM {name}_view)")
    spark.catalog.dropTempView(name + "_view")
    return F.expr(f"system.session.{name}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, the columns ``keep``, ``n_words``, ``spans`` and ``items`` for every row of ``docs``.

    ``spans``: array<struct<start, end>> of word positions (from 0, end
    exclusive) covered by occurring windows, merged, ascending. ``items``: the
    ids of the items with occurring windows, as strings, ascending. Null texts
    have no words. Rows that share an id and differ in text have results of
    their own; exact repeats have equal ones. Null ids are kept; a null item id
    is called ``null``. Empty tables and an empty benchmark give no spans.
    Further columns are not looked at.
    """
    wins = written(windows(benchmark, n, item_col, item_text_col), "windows")
    groups = wins.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = wins.groupBy("size").count().collect()  # one row for each window length, n at most
    if sum(r["count"] for r in known) <= BROADCAST_WINDOWS:
        groups = F.broadcast(groups)
    bits = _shipped_map(wins)

    def survivors(w: Column, size: int) -> Column:
        def passing(h: Column) -> Column:
            there = lambda x: F.bit_get(F.get(bits, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
            return F.filter(F.transform(h, lambda x, i: F.when(there(x), i)), lambda i: i.isNotNull())

        hashes = lambda o: F.transform(F.sequence(F.lit(1), F.size(o) - (size - 1)), lambda i: _window_hash(o, i, size).bitwiseAND(F.lit(MAP_BITS - 1)))
        at = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda o: _let(hashes(o), passing))
        rows = F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(w, i + 1, size), " ").alias("window")))
        return F.when(F.size(w) >= size, rows).otherwise(F.array().cast("array<struct<start:int,size:int,window:string>>"))

    names = [id_col, *(c for c in keep if c != id_col)]
    out = [F.col(c).alias(f"_{i}") for i, c in enumerate(names)]
    read = docs.select(text_id(id_col).alias("key"), F.xxhash64(text_col).alias("version"), *out, words(F.col(text_col)).alias("w"))
    none = F.array().cast("array<struct<start:int,size:int,window:string>>")
    tested = _let(F.col("w"), lambda w: F.concat(none, *[survivors(w, size) for size in sorted(r["size"] for r in known)]))
    kept = [f"_{i}" for i in range(len(names))]
    scanned = written(read.select("key", "version", *kept, F.size("w").alias("n_words"), tested.alias("tested")), "scanned")
    hits = scanned.select("key", "version", F.explode("tested").alias("t")).join(groups, [F.col("t.size") == F.col("size"), F.col("t.window") == F.col("window")])
    hits = hits.select("key", "version", F.col("t.start").alias("start"), (F.col("t.start") + F.col("t.size")).alias("end"), "items")
    found = hits.groupBy("key", "version").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    spans = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, h: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= h["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], h["end"]).alias("end"))))
        ).otherwise(F.concat(acc, F.array(h))),
    )
    merged = written(found.select("key", "version", spans.alias("spans"), "items"), "hits")
    counted = scanned.select("key", "version", *kept, "n_words")
    return counted.join(merged, ["key", "version"], "left").select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def n_hit(spans: Column) -> Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])


def is_contaminated(n_words: Column, hit: Column, parts: int = 20) -> Column:
    """At least one part in ``parts`` of the words is hit."""
    return (hit > 0) & (hit * parts >= n_words)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words inside the spans; what stands between two removed words goes too."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gone = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
    gap = lambda gaps, i: F.get(gaps, i)

    def build(parts: Column) -> Column:
        kept = F.transform(
            parts["words"],
            lambda w, i: F.when(gone(i) & gone(i + 1), "").when(gone(i), gap(parts["gaps"], i + 1)).otherwise(F.concat(w, gap(parts["gaps"], i + 1))),
        )
        return F.concat(gap(parts["gaps"], F.lit(0)), F.array_join(kept, ""))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(f"({word})"), F.lit(1)).alias("words"), F.split(text, word, -1).alias("gaps")), build)
