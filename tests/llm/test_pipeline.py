"""The pipeline against a brute-force version of its stages' decisions."""

import pytest
from pyspark.sql import functions as F
from test_near_copies import brute

import corpus_pipeline as pipeline
from tessella.llm import decontam, queries


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def roots(docs):
    return set(brute({r.doc_id: r.text for r in docs.collect()}).values())


def test_stages_in_turn(spark, small):
    docs = queries.table(spark, small, "documents").cache()
    junk = docs.limit(1).select(F.lit(900_000).cast("long").alias("doc_id"), F.lit("12 34 ?!").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(8).cast("long").alias("n_chars"))
    known = pipeline.language_id(spark, docs.unionByName(junk), small)
    assert known.columns == docs.columns and ids(known) == ids(docs)
    single = pipeline.near_dedup(spark, docs.unionByName(docs.limit(5)), small)
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(roots(docs))
    clean = pipeline.decontamination(spark, docs, small)
    dirty = {r.doc_id for r in queries.op6_benchmark_decontamination(spark, small).collect() if r.contaminated}
    assert dirty and ids(clean) == ids(docs) - dirty
    hidden = {r.doc_id: r for r in pipeline.secrets(spark, docs, small).collect()}
    found = {r.doc_id: r.spans for r in queries.op7_secret_scan(spark, small).collect()}
    assert len(hidden) == docs.count()
    for d in docs.collect():
        assert ("[SECRET]" in hidden[d.doc_id].text) == bool(found[d.doc_id]) and hidden[d.doc_id].n_chars == len(hidden[d.doc_id].text)


def test_run(spark, small):
    out = pipeline.run(spark, small)
    kept = {r[0] for r in out.select("doc_id").distinct().collect()}
    dirty = {r.doc_id for r in queries.op6_benchmark_decontamination(spark, small).collect() if r.contaminated}
    assert kept == roots(queries.table(spark, small, "documents")) - dirty
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "best_fit_packing"]
    assert decontam.windows(queries.table(spark, small, "benchmark")).count() > 0


EXTRA = ("spans", "score", "items", "lang_pred", "rejected", "n_words", "row", "doc", "key", "version", "_maybe", "h", "id", "clean", "ids", "w", "piece", "sequence_id", "bits")


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stage_edges(spark, small, name, stage):
    """Nulls in any column, repeated rows, empty and very long texts, and extra columns named like the stages' own."""
    base = queries.table(spark, small, "documents").limit(40)
    schema = base.schema
    rows = [(None, None, None, None, None), (9007, None, "en", None, 0), (9007, None, "en", None, 0), (9008, "", None, "s", 0), (None, "one two three " * 60_000, None, "s", 9), (9009, " \n\t", "en", "s", 3)]
    docs = base.unionByName(spark.createDataFrame(rows, schema)).withColumns({c: F.lit(c) for c in EXTRA})
    out = stage(spark, docs, small)
    assert stage(spark, docs.limit(0), small).count() == 0
    if name == "best_fit_packing":
        assert out.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
        return
    assert out.columns == docs.columns
    got = out.collect()
    assert all(getattr(r, c) == c for r in got for c in EXTRA)
    if name == "language_id":
        assert ids(base) <= {r.doc_id for r in got} and not {r.doc_id for r in got} & {9007, 9008, 9009}
    elif name == "near_dedup":  # the texts without words are one group; so is the long one
        assert len(got) == len(roots(base)) + 2 and sum(not (r.text or "").strip() for r in got) == 1
    elif name == "decontamination":
        assert sum(r.text is None for r in got) == 3 and {9008, 9009} <= {r.doc_id for r in got}
    else:
        assert len(got) == 46 and sum(r.text is None for r in got) == 3
