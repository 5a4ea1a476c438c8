"""Vectors as array columns: normalising, similarity to a small set of references, classification.

The references (prompts, prototypes, characters) are few and fixed; their
count is checked before they go to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import boxes
from tessella.session import written

#: References at most; they travel as one value.
MOST_REFERENCES = 10_000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """L2-normalised, the norm at least 1e-8."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(1e-8))), lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def similarities(vectors: DataFrame, references: DataFrame, key: str = "vec_id", vector: str = "embedding", ref: str = "ref", ref_vector: str = "ref_embedding") -> DataFrame:
    """``key``, the columns of ``references`` but its vector, and ``sim`` (cosine) for each vector and reference.

    The references go to every task as one array, so nothing is joined. More
    than ``MOST_REFERENCES`` of them are an error.
    """
    unit = vectors.select(key, normalize(F.col(vector)).alias("_v"))
    refs = references.withColumn("_r", normalize(F.col(ref_vector))).drop(ref_vector)
    if refs.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    listed = refs.agg(F.collect_list(F.struct("*"))).scalar()
    return unit.select("*", F.inline(listed)).withColumn("sim", dot(F.col("_v"), F.col("_r"))).drop("_v", "_r")


def confidence(sims: DataFrame, key: str, ref: str, scale: float = 50.0) -> DataFrame:
    """The best reference of each vector and the sigmoid of its lead over the second, times ``scale``; 1 if there is one only."""
    return _leads(sims, key, ref, scale).select(key, ref, F.round("sim", 5).alias("sim"), F.round("p", 4).alias("p"))


def _leads(sims: DataFrame, key: str, ref: str, scale: float) -> DataFrame:
    """``confidence`` with all digits; among equal similarities a null reference comes last."""
    order = Window.partitionBy(key).orderBy(F.col("sim").desc(), F.col(ref).asc_nulls_last())
    placed = sims.withColumns({"_at": F.row_number().over(order), "_second": F.lead("sim").over(order)}).where("_at = 1")
    lead = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(scale) * (F.col("sim") - F.col("_second")))), F.lit(1.0))
    return placed.select(key, ref, "sim", lead.alias("p"))


def softmax(sims: DataFrame, key: str, scale: float) -> DataFrame:
    """``sims`` with ``p``: softmax of ``scale * sim`` over each key."""
    w = Window.partitionBy(key)
    e = sims.withColumn("_e", F.exp(F.lit(scale) * (F.col("sim") - F.max("sim").over(w))))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def zero_shot(sims: DataFrame, key: str, group: str, scale: float, how: str) -> DataFrame:
    """Scores of groups of prompts: ``sum`` of the prompts' probabilities; their ``mean``, shares renormalised; ``max`` similarity, then softmax."""
    if how == "max":
        best = sims.groupBy(key, group).agg(F.max("sim").alias("sim"))
        return softmax(best, key, scale).select(key, group, F.round("p", 4).alias("p"))
    p = softmax(sims, key, scale).groupBy(key, group).agg((F.sum("p") if how == "sum" else F.avg("p")).alias("p"))
    if how == "mean":
        p = p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))
    return p.select(key, group, F.round("p", 4).alias("p"))


def zero_shot_windows(sims: DataFrame, item: str, window: str, group: str, prompt: str, scale: float) -> DataFrame:
    """``item, group, p, mood, top``: groups of prompts for items that were heard in several windows.

    The probabilities of each window are averaged over the windows, then over
    the prompts of each group, so neither many windows nor many prompts weigh
    more; ``p`` are the groups' shares (4 digits). ``mood`` is 0.5 where a group
    is as likely as the mean of all, and 1 from twice that on (3 digits).
    ``top`` is the likeliest prompt, the least of several. Prompts are told
    apart by their ids over all groups.
    """
    heard = softmax(sims, window, scale).groupBy(item, group, prompt).agg(F.avg("p").alias("p"))
    part = Window.partitionBy(item)
    best = F.struct(F.col("p").alias("p"), (-F.col(prompt)).alias("prompt"))
    groups = heard.groupBy(item, group).agg(F.avg("p").alias("_mean"), F.max(best).alias("_best"))
    share = F.col("_mean") / F.sum("_mean").over(part)
    return groups.select(
        item, group, F.round(share, 4).alias("p"), F.round(F.least(F.lit(1.0), share * F.count("*").over(part) / 2), 3).alias("mood"), (-F.max("_best").over(part)["prompt"]).alias("top"),
    )


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key`` and ``mean``: the normalised mean vector of each group, by partial sums of each dimension."""
    dims = df.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean"))
    return whole.select(key, normalize(F.col("mean")).alias("mean"))


def first_seeds(sims: DataFrame, key: str = "vec_id", ref: str = "ref", count: int = 5) -> DataFrame:
    """``ref`` and ``key`` of the ``count`` clearest faces of each reference: by z of the similarity over all faces, and its lead over the second best z."""
    moments = sims.groupBy(ref).agg(F.avg("sim").alias("_mean"), F.stddev_pop("sim").alias("_dev"))
    z = sims.join(F.broadcast(moments), ref).withColumn("_z", (F.col("sim") - F.col("_mean")) / (F.col("_dev") + F.lit(1e-6)))
    order = Window.partitionBy(key).orderBy(F.col("_z").desc(), ref)
    best = z.withColumns({"_at": F.row_number().over(order), "_second": F.lead("_z").over(order)}).where("_at = 1")
    best = best.withColumn("_margin", F.col("_z") - F.coalesce("_second", F.lit(0.0))).where("_margin > 0")
    at = F.row_number().over(Window.partitionBy(ref).orderBy(F.col("_margin").desc(), key))
    return best.withColumn("_at", at).where(F.col("_at") <= count).select(ref, key)


def identify(faces: DataFrame, references: DataFrame, rounds: int = 3, seed_p: float = 0.8, weight: float = 0.25, scale: float = 50.0, least: float = 0.6, top: int = 300, first: int = 5) -> DataFrame:
    """Semi-supervised prototypes: faces (``face_id, embedding``) to references (``ref, ref_embedding``; the mean, if one has several).

    ``first_seeds`` make the first prototypes. Each round assigns all faces
    and takes the sure ones as seeds; a reference without any keeps those it
    had. A single reference competes with the mean face. The last round's
    assignment counts; faces below ``least`` have no character and p 0.
    """
    f = faces.withColumnRenamed("face_id", "vec_id")
    units = references.select("ref", normalize(F.col("ref_embedding")).alias("ref_embedding"))
    refs = written(mean_vectors(units, "ref", "ref_embedding").withColumnRenamed("mean", "ref_embedding"), "references")
    unit = f.select("vec_id", normalize(F.col("embedding")).alias("embedding"))
    single = refs.count() == 1
    if single:
        face = mean_vectors(unit.withColumn("_all", F.lit(1)), "_all").select(F.lit(None).cast(refs.schema["ref"].dataType).alias("ref"), F.col("mean").alias("ref_embedding"))
    seeds = written(first_seeds(similarities(f, refs), count=first), "seeds")
    best = None
    for k in range(max(1, rounds)):
        means = mean_vectors(seeds.join(unit, "vec_id"), "ref")
        blend = normalize(F.zip_with("mean", "ref_embedding", lambda a, b: (1 - weight) * a + weight * b))
        now = refs.join(means, "ref", "left").select("ref", F.when(F.col("mean").isNull(), F.col("ref_embedding")).otherwise(blend).alias("ref_embedding"))
        best = _leads(similarities(f, now.unionByName(face) if single else now), "vec_id", "ref", scale)
        if k + 1 < rounds:
            at = F.row_number().over(Window.partitionBy("ref").orderBy(F.col("p").desc(), "vec_id"))
            sure = written(best.where(F.col("ref").isNotNull() & (F.col("p") >= seed_p)).withColumn("_at", at).where(F.col("_at") <= top).select("ref", "vec_id"), "sure")
            seeds = written(sure.unionByName(seeds.join(sure.select("ref").distinct(), "ref", "left_anti").select("ref", "vec_id")), "seeds")
    known = F.col("ref").isNotNull() & (F.col("p") >= least)
    return best.select(F.col("vec_id").alias("face_id"), F.when(known, F.col("ref")).alias("character"), F.when(known, F.round("p", 4)).otherwise(F.lit(0.0)).alias("p"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes given as x, y, width, height."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


def nms(found: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Greedy suppression of boxes (``box_id, x, y, w, h, score``) in each group: best score first, ties by id; those that overlap a kept one by more than ``threshold`` go."""
    gone = boxes.beaten(boxes.overlaps(found, by, threshold, box_iou), by).withColumnRenamed("id", "box_id")
    return found.join(gone, [*by, "box_id"], "left_anti").select(*by, "box_id", F.col("score").cast("double").alias("score"))
