"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order character models, of random strings and of ordinary
identifiers, are trained from labelled samples. A token's score is its
log-likelihood ratio, the sum over its transitions, so that a short token
needs to look more random than a long one, and no length is left out. A token
counts as a secret if its score reaches a threshold that is fitted on a part
of the labelled samples that the models have not seen. One tokeniser serves
training and scanning.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches, bounded_sample

# The patterns. ------------------------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")
# -------------------------------------------------------------------------------------------------------------------------
#: Tokens are the longest runs of these characters.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
OUT = len(ALPHABET)
#: Documents asked for ordinary tokens, distinct tokens taken from them, characters of a token that are learned from, and random strings drawn.
SAMPLE_DOCS, SAMPLE_TOKENS, TOKEN_CHARACTERS, SAMPLE_RANDOM = 400, 40_000, 200, 6000
#: One labelled sample of so many fits the threshold; shares of the held-out ordinary tokens below it and of the held-out keys above it that it stands between.
HELD, ORDINARY_BELOW, KEYS_ABOVE = 5, 0.9999, 0.95
#: Characters of a text that are scored at a time.
CHARACTERS_AT_ONCE = 1 << 20

#: Identifiers labelled ordinary that the sample always holds, so that the model of ordinary strings stands on few documents too.
ORDINARY = (
    "configuration initialize getUserName set_default_value maximum_retry_count internationalization document-builder-factory http_response "
    "application/json content_length background-color createElement addEventListener transaction_identifier department customer_address "
    "temperature_sensor connection_timeout organization experimental_feature isEnabled parseArguments numberOfElements database_schema "
    "synchronization authentication administrator environment_variables src/main/resources table_partition understanding communication "
    "responsibility characteristics approximately simultaneously questionnaire environmental representative entertainment particularly"
).split()

_CODE = np.full(129, OUT, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(OUT)
_OUTSIDE = re.compile("[^" + re.escape(ALPHABET) + "]")
# The patterns as Spark's regular expressions: what they find is not ordinary.
_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"""


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def codes_of(text: str) -> np.ndarray:
    """For each code point its place in the alphabet, or ``OUT``."""
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


def transitions(samples: Iterable[str], weight: float = 4.0) -> np.ndarray:
    """Log probabilities of the next character, by the one before. Rare rows lean on the characters' own shares, by ``weight`` counts."""
    codes = codes_of(" ".join(samples))
    inside = (codes[:-1] != OUT) & (codes[1:] != OUT)
    counts = np.bincount(codes[:-1][inside] * OUT + codes[1:][inside], minlength=OUT * OUT).reshape(OUT, OUT)
    single = counts.sum(axis=0) + 0.25
    return np.log((counts + weight * single / single.sum()) / (counts.sum(axis=1, keepdims=True) + weight))


@dataclass
class Models:
    """Log-likelihood ratios of transitions, random against ordinary (zero to and from other characters), and the threshold."""

    table: np.ndarray
    threshold: float = 0.0

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and scores of the tokens of a text."""
        codes = codes_of(text)
        inside = np.concatenate([[False], codes != OUT, [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        upto = np.concatenate([[0.0], np.cumsum(self.table[codes[:-1], codes[1:]])]) if len(codes) else np.zeros(1)
        return starts, ends, upto[ends - 1] - upto[starts]

    def random_tokens(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the tokens whose score reaches the threshold. Long texts are cut between tokens."""
        out, at = [], 0
        while at < len(text):
            cut = _OUTSIDE.search(text, at + CHARACTERS_AT_ONCE)
            end = cut.start() if cut else len(text)
            starts, ends, scores = self.scores(text[at:end])
            found = scores >= self.threshold
            out += [(at + s, at + e) for s, e in zip(starts[found].tolist(), ends[found].tolist())]
            at = end
        return out


def random_strings(count: int, seed: int = 7) -> list[str]:
    """Samples labelled random: keys over the usual alphabets, of 16 to 48 characters."""
    draw = random.Random(seed)
    letters, digits = string.ascii_letters, string.digits
    kinds = [letters + digits, letters + digits + "+/", letters + digits + "-_", string.hexdigits[:16], string.ascii_uppercase + digits, string.ascii_lowercase + digits, letters, string.ascii_lowercase]
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(16, 48))) for i in range(count)]


def identifiers(words: list[str], count: int, seed: int = 7) -> list[str]:
    """Samples labelled ordinary: names, paths, versions, dates and numbers, made of words as programs and their logs have them."""
    draw, out = random.Random(seed), []
    short = [w for w in words if 2 <= len(w) <= 12 and w.isalpha()] or ["value"]
    number = lambda: str(draw.randint(0, 10 ** draw.randint(1, 4)))
    for i in range(count):
        parts = [w + (number() if draw.random() < 0.2 else "") for w in draw.choices(short, k=draw.randint(2, 5))]
        camel = parts[0].lower() + "".join(p.capitalize() for p in parts[1:])
        dated = f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}"
        made = ("_".join(parts), "-".join(parts), camel, "_".join(parts).upper(), "/".join(parts), "/" + "/".join([*parts, camel[0].upper() + camel[1:]]),
                f"{parts[0]}-{dated}", f"v{number()}-{parts[0]}", f"{draw.randint(10**8, 10**18)}", f"{dated}T{draw.randint(10, 23)}-{draw.randint(10, 59)}", f"{parts[0]}={parts[1]}")
        out.append(made[i % len(made)])
    return out


def train(ordinary: list[str], found: Iterable[str] = (), n_random: int = SAMPLE_RANDOM) -> Models:
    """Models and threshold from labelled samples. Random: drawn keys, and strings that the patterns ``found``. Ordinary: tokens of texts, a fixed list, names made of them.

    A text may hold keys that no pattern knows. So what models without the
    texts find is not labelled ordinary when the texts' tokens are learned.
    """
    keys = [*random_strings(n_random), *found]
    made = lambda words, count: [*5 * ORDINARY, *identifiers([*words, *(w for t in ORDINARY for w in re.findall("[A-Za-z]+", t))], count)]
    without = _trained(keys, made([], 2000))
    clean = [t for t, score in zip(ordinary, without.scores(" ".join(ordinary))[2]) if score < without.threshold]
    return _trained(keys, [*clean, *made([t for t in clean if t.isalpha()], max(2000, len(clean) // 4))])


def _trained(keys: list[str], names: list[str]) -> Models:
    parts = [[x for i, x in enumerate(of) if (i % HELD == 0) == held] for of in (keys, names) for held in (False, True)]
    table = np.zeros((OUT + 1, OUT + 1))
    table[:OUT, :OUT] = transitions(parts[0]) - transitions(parts[2])
    models = Models(table)
    low, high = np.quantile(models.scores(" ".join(parts[1]))[2], 1 - KEYS_ABOVE), np.quantile(models.scores(" ".join(parts[3]))[2], ORDINARY_BELOW)
    models.threshold = float(max(high, (high + low) / 2))
    return models


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Models:
    """Models trained on the tokens of a sample of documents, chosen by the hashes of their ids.

    The driver gets at most ``sample_tokens`` distinct tokens, each of at most
    ``TOKEN_CHARACTERS`` characters, and never a text.
    """
    sample = bounded_sample(docs.select(id_col, F.col(text_col).cast("string").alias("text")).where(F.col(text_col).isNotNull()), id_col, sample_docs)
    rest = F.regexp_replace("text", _BASE, " ")
    token = F.explode(F.regexp_extract_all(rest, F.lit("([A-Za-z0-9+/_=-]{2,})"), F.lit(1)))
    tokens = sample.select(token.alias("t")).select(F.left("t", F.lit(TOKEN_CHARACTERS)).alias("t")).distinct()
    return train([r["t"] for r in tokens.orderBy(F.xxhash64("t"), "t").limit(sample_tokens).collect()])


def markov_spans(text: str, taken: list[tuple[int, int, str]], models: Models) -> list[tuple[int, int, str]]:
    """Random-looking tokens that overlap no span in ``taken`` (by start)."""
    out, found = [], models.random_tokens(text)
    if not taken:
        return [(s, e, "markov") for s, e in found]
    starts, reach = [t[0] for t in taken], np.maximum.accumulate([t[1] for t in taken])
    for s, e in found:
        before = int(np.searchsorted(starts, e)) - 1  # the last span that starts before the token's end
        if before < 0 or reach[before] <= s:
            out.append((s, e, "markov"))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, keep: tuple[str, ...] = (), models: Models | None = None) -> DataFrame:
    """``id_col``, the columns ``keep``, and ``spans`` (array<struct<kind, start, end>>: code points, end exclusive) for every row.

    The models are those given, or ``fit`` to ``docs``. Spans are ordered by
    start, kind and end. Null and empty texts have none. Repeated rows give
    equal results, null ids are kept, an empty table gives none. Columns that
    are not named are not looked at.
    """
    bounded_batches(docs.sparkSession)
    models = models or fit(docs, id_col, text_col, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = []
            for t in b.column(0):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + markov_spans(text, base, models), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                found.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, kind)], [*b.schema.names[1:], "spans"])

    out = [id_col, *(c for c in keep if c != id_col)]
    rows = docs.select(F.col(text_col).cast("string").alias("_scanned"), *out)
    spans = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
    return rows.mapInArrow(run, T.StructType([*[docs.schema[c] for c in out], T.StructField("spans", spans)]))


def redact(text, spans, mark: str = "[SECRET]"):
    """Column: the text with every span replaced by ``mark``; overlapping spans become one."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(merged), lambda m: F.concat(m["out"], F.substring(text, m["at"] + 1, F.length(text))))[0])
