"""Names, labels, file names and subtitle lines as column functions; Python only where no built-in function has the semantics."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())


@F.pandas_udf(T.StringType())
def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else _plain(s).strip())


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str, str]:
    """Characters beyond ASCII that mean a letter, a digit or nothing, what they mean (those that mean nothing stand last), and a pattern that finds all that mean several."""
    single, nothing, several = {}, [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        plain = _plain(chr(code))
        if plain == "":
            nothing.append(chr(code))
        elif plain != " ":
            single[chr(code)] = plain
            if len(plain) > 1:
                del single[chr(code)]
                several.append(code)
    ranges = []
    for code in several:
        # Beyond the alphabets small gaps do no harm: the pattern may find more.
        if ranges and code - ranges[-1][1] <= (1 if code < 0x2100 else 16):
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join([*single, *nothing]), "".join(single.values()), "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def normalize_name(text: Column | str) -> Column:
    """Lower case without accents; runs of anything but a-z and 0-9 are one space.

    Texts with a character that stands for several (such as a ligature) go to
    Python, all others do not.
    """
    text, (characters, meanings, several) = F.col(text) if isinstance(text, str) else text, _folded()
    rare = F.rlike(text, F.lit(several))
    native = F.trim(F.lower(F.regexp_replace(F.translate(text, characters, meanings), "[^A-Za-z0-9]+", " ")))
    return F.coalesce(F.when(~rare, native), _normalized(F.when(rare, text)))


def name_score(query: Column, name: Column) -> Column:
    """3 for equal names, 2 if all words of the query are in the name, 1 for a part of it, else 0. Both normalised; an empty query has 0."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return (
        F.when(query == "", 0).when(query == name, 3).when(F.size(F.array_except(words(query), words(name))) == 0, 2).when(F.instr(name, query) > 0, 1).otherwise(0)
    )


@F.pandas_udf(T.DoubleType())
def title_score(query: pd.Series, title: pd.Series) -> pd.Series:
    """Similarity of two normalised titles by matching blocks; at least 0.9 if all words of the query (of 4 characters or more) are in the title."""

    def score(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        return max(ratio, 0.9) if len(a) >= 4 and {*a.split()} <= {*b.split()} else ratio

    return pd.Series([score(a, b) for a, b in zip(query, title)])


def split_names(text: Column, separators: str = "[;,/|]") -> Column:
    """Parts between separators, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separators), lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column) -> Column:
    """A name fit for a file: normalised, with _ between words; ``untitled`` if nothing is left."""
    return F.coalesce(F.nullif(F.replace(normalize_name(text), F.lit(" "), F.lit("_")), F.lit("")), F.lit("untitled"))


def language_rank(tags: Column, languages: list[str]) -> Column:
    """Position of the best of a file's language tags among the wanted ones; their number if none is wanted."""
    at = F.transform(tags, lambda t: F.nullif(F.array_position(F.array(*map(F.lit, languages)), t), F.lit(0)) - 1)
    return F.coalesce(F.array_min(at), F.lit(len(languages)))


def spoken(text: Column) -> Column:
    """Whether a subtitle line is speech: not empty, no positioned sign, no lyrics mark, not wholly in brackets."""
    plain = F.trim(F.regexp_replace(text, r"\{[^}]*\}", ""))
    return (plain != "") & ~F.rlike(text, F.lit(r"\\pos\(|\\move\(")) & ~F.rlike(plain, F.lit("^[♪♫]")) & ~F.rlike(plain, F.lit(r"^[\[(][^\])]*[\])]$"))


def mmss(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.concat((whole / 60).cast("long").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def signature(*parts: Column) -> Column:
    """16 hex characters of the SHA-1 over the JSON list of the parts as strings."""
    return F.substring(F.sha1(F.to_json(F.array(*[p.cast("string") for p in parts])).cast("binary")), 1, 16)
