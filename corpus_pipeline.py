"""A corpus pipeline of five of the training-data operators, stage by stage over the documents.

Every stage takes documents with nulls in any column, repeated rows, texts of
any length, no rows at all, and further columns of any names, which go through
unchanged: working columns stand beside the row as one struct and never clash
with it. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, langid, near_copies, packing, secret_scan
from tessella.llm.common import new_path, sieve, text_id, whole_row, written
from tessella.llm.queries import table, tokenizer

#: Words whose ids a worker of the last stage keeps; few, because the workers of the stages before still hold what they have.
KEPT_WORDS = 100_000


def _beside(docs: DataFrame, **columns) -> DataFrame:
    """``doc``, the row, and the columns named."""
    return docs.select(whole_row(docs).alias("doc"), *[c.alias(name) for name, c in columns.items()])


def _row() -> F.Column:
    """What tells rows apart: the id and a hash of the text, as a struct. Rows that are equal in both are repeats."""
    return F.struct(text_id("doc_id").alias("key"), F.xxhash64("text").alias("version"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` lists in ``row``. Only rows that a small bit map of them lets through travel to be compared."""
    marked = sieve(_beside(docs, row=_row()), F.xxhash64("row"), gone.select(F.xxhash64("row").alias("h")))
    kept = marked.where("not _maybe").unionByName(marked.where("_maybe").join(gone.select("row"), "row", "left_anti").select(*marked.columns))
    return kept.select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` takes the prediction.

    Documents without a letter (null and empty texts too) and those with a
    calibrated score below ``langid.REJECT_BELOW`` go.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.identify(_beside(docs, text=F.col("text")), model, keep=("doc",)).where(~F.col("rejected"))
    known = F.coalesce(F.col("doc.lang"), F.col("lang_pred")).alias("lang")
    return out.select(*[known if c == "lang" else F.col(f"doc.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest id (then text hash), once.

    Documents link by fingerprints, as in op2, or by five-word shingles with a
    likeness of 0.8 or more. Texts without words (nulls too) are one component.
    """
    classes = near_copies.near_copies(docs.select(_row().alias("row"), "text"), id_col="row")
    counted = written(classes.groupBy("row").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id")), "classes")
    rest = _without(docs, counted.where("row <> component_id or n > 1"))
    repeated = counted.where("row = component_id and n > 1")
    if repeated.isEmpty():
        return rest
    some = sieve(_beside(docs, row=_row()), F.xxhash64("row"), repeated.select(F.xxhash64("row").alias("h"))).where("_maybe")
    once = some.join(repeated.select("row"), "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
    return rest.unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not contaminate (op6's rule); those without words stay."""
    row = docs.select(_row().alias("row"), F.col("text").cast("string").alias("text")).withColumn("id", F.col("row.key"))
    found = decontam.contamination(row, table(spark, sf_dir, "benchmark"), id_col="id", keep=("row",))
    dirty = found.where(decontam.is_contaminated(F.col("n_words"), decontam.n_hit(F.col("spans"))))
    return _without(docs, written(dirty.select("row").distinct(), "contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; ``n_chars`` counts the new text (a null text keeps its own)."""
    found = secret_scan.scan(_beside(docs, doc_id=F.col("doc_id"), text=F.col("text")), keep=("doc",))
    text = F.col("doc.text")
    clean = found.select("doc", secret_scan.redact(text, F.col("spans")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("doc.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return clean.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), kept_words=KEPT_WORDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the fingerprints, models and tokenizers of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
