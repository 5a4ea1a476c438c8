"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words' character n-grams (hashed
into a fixed number of buckets), followed by a linear layer and a softmax.
Both layers are trained with stochastic gradient descent in numpy on the
driver, on a bounded sample of labelled rows. A temperature fitted on rows
that training has not seen calibrates the scores, and texts whose calibrated
score is low are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches

#: Labelled documents for each language in the training sample; all of a smaller language.
SAMPLE_DOCS = 500
BUCKET_BITS, WIDTH, GRAMS = 14, 16, (1, 2, 3, 4)
BUCKETS = 1 << BUCKET_BITS
#: Words of one training example: documents are cut so that short texts are learned too.
EXAMPLE_WORDS = (3, 12, 40)
EPOCHS, RATE, BATCH = 4, 0.5, 64
#: Training examples of each label at least, however many labels there are.
LABEL_EXAMPLES = 6_000
#: Calibrated scores below this are rejected.
REJECT_BELOW = 0.6
UNKNOWN = "und"
#: Words whose n-grams are hashed at a time.
WORDS_AT_ONCE = 50_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def buckets(found: list[str]) -> np.ndarray:
    """Hash buckets of the byte n-grams of words, each with its edges marked."""
    b = np.frombuffer(("<" + "><".join(found) + ">").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    ends, gram, inside, out = b == ord(">"), np.zeros(len(b), np.uint32), np.ones(len(b), bool), []
    for n in range(1, max(GRAMS) + 1):
        if n > 1:  # a gram ends where its word ends
            inside = inside[:-1] & ~ends[n - 2 : len(b) - 1]
        size = len(inside)
        gram = (gram[:size] << np.uint32(8)) | b[n - 1 :]
        if n in GRAMS:
            out.append((((gram + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS))[inside])
    return np.concatenate(out)


@dataclass
class Model:
    """Logits of each bucket (embedding times linear layer), bias, labels and temperature."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = REJECT_BELOW

    def logits(self, text: str | None) -> np.ndarray | None:
        """Mean over all n-grams of all words; None without a letter."""
        found = words(text)
        if not found:
            return None
        counts = sum(np.bincount(buckets(found[i : i + WORDS_AT_ONCE]), minlength=BUCKETS) for i in range(0, len(found), WORDS_AT_ONCE))
        return counts @ self.table / counts.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, calibrated score); ``und`` and 0 for null or a text without letters."""
        z = self.logits(text)
        if z is None or not self.labels:
            return UNKNOWN, 0.0
        e = np.exp((z - z.max()) / self.temperature)
        best = int(np.argmax(e))
        return self.labels[best], float(e[best] / e.sum())


def _examples(texts: list[str], seed: int) -> list[list[str]]:
    """The documents cut into runs of words, whole, in lengths that vary."""
    draw, out = np.random.default_rng(seed), []
    for t in texts:
        found, at = words(t), 0
        while at < len(found):
            size = int(draw.choice(EXAMPLE_WORDS))
            out.append(found[at : at + size])
            at += size
    return out


def train(rows: list[tuple[str, str]], seed: int = 3, max_examples: int = 24_000, label_examples: int = LABEL_EXAMPLES) -> Model:
    """A model from (text, label) rows; every tenth row is kept for the calibration.

    The runs of words of a label that are learned are all or a draw of
    ``label_examples``; more where few labels share ``max_examples``.
    """
    texts: dict[str, list[str]] = {}
    for t, label in rows:
        texts.setdefault(label, []).append(t)
    labels, most = sorted(texts), max(label_examples, max_examples // max(1, len(texts)))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    draw = np.random.default_rng(seed)
    x, y, held = [], [], []
    for k, label in enumerate(labels):
        own = texts[label]
        cut = len(own) // 10
        held += [(e, k) for e in _examples(own[:cut], seed)]
        made = _examples(own[cut:], seed + k)
        for i in draw.permutation(len(made))[:most]:
            x.append(buckets(made[i]))
            y.append(k)
    y = np.array(y, np.int64)
    emb = draw.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = draw.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, len(labels))), np.zeros(len(labels))
    steps, step = EPOCHS * (-(-len(x) // BATCH)), 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            ids, sizes = np.concatenate([x[i] for i in part]), np.array([len(x[i]) for i in part])
            used, place = np.flatnonzero(np.bincount(ids, minlength=BUCKETS)), np.zeros(BUCKETS, np.int64)
            place[used] = np.arange(len(used))
            cell = np.repeat(np.arange(len(part)) * len(used), sizes) + place[ids]
            share = np.bincount(cell, minlength=len(part) * len(used)).reshape(len(part), len(used)) / sizes[:, None]
            hidden = share @ emb[used]
            z = hidden @ out + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            grad = e / e.sum(axis=1, keepdims=True)
            grad[np.arange(len(part)), y[part]] -= 1
            back = grad @ out.T
            out -= rate * hidden.T @ grad / len(part) * 8
            bias -= rate * grad.mean(axis=0)
            emb[used] -= rate * (share.T @ back) * 4
    model = Model(labels, emb @ out, bias)
    model.temperature = _temperature(model, held)
    return model


def _temperature(model: Model, held: list[tuple[list[str], int]]) -> float:
    """The temperature with the least log loss on held-out examples."""
    pairs = [(z, k) for e, k in held if (z := model.logits(" ".join(e))) is not None]
    if not pairs:
        return 1.0
    z, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def loss(t: float) -> float:
        s = (z - z.max(axis=1, keepdims=True)) / t
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 20, 60).tolist(), key=loss)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled rows of ``docs``, at most ``sample_docs`` for each label, chosen by the hash of their ids. Every label is learned."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    lot, grain = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)), 1 << 30
    drawn = labelled.select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), lot.alias("lot"))
    share = F.floor(F.lit(grain) * F.least(F.lit(1.0), F.lit(2.0 * sample_docs + 50) / F.col("count")))
    sizes = drawn.groupBy("label").count().select("label", share.alias("share"))
    drawn = drawn.join(F.broadcast(sizes), "label").where(F.col("lot") <= F.col("share")).withColumn("version", F.xxhash64("text")).drop("share")
    first = F.row_number().over(Window.partitionBy("label").orderBy("lot", "version"))
    rows = drawn.withColumn("nth", first).where(F.col("nth") <= sample_docs).orderBy("label", "nth").select("text", "label").collect()
    rows = [(r["text"], r["label"]) for r in rows]
    return train(rows)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred``, ``score`` and ``rejected`` for every row.

    Null texts and texts without a letter are ``und`` with score 0 and are
    rejected, as are scores below the model's limit. Whole texts count.
    Repeated rows give equal results; an empty table gives none. Columns that
    are not named are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(0)]
            labels, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], labels, scores], [*b.schema.names[1:], "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    kinds = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = docs.select(F.col(text_col).cast("string").alias("_read"), *keep).mapInArrow(run, kinds)
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.reject_below))


def held_out(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether a row is in the fold that training never sees."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))
