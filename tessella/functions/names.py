"""What names of files, folders and songs tell: numbers of seasons and episodes, titles, artists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How names mark episodes and seasons, exact marks first, and numbers that mean pictures and codecs.
EPISODE_MARKS = (r"S[0-9]{1,2}\s*E([0-9]{1,4})", r"\b[0-9]{1,2}x([0-9]{1,4})\b", r"\b(?:Episode|Folge|Ep)\.?\s*([0-9]{1,4})\b", r"\bE([0-9]{1,4})\b", r"\s-\s([0-9]{1,4})(?:v[0-9])?\b")
SEASON_MARKS = (r"\bS([0-9]{1,2})\s*E[0-9]", r"\b([0-9]{1,2})x[0-9]{1,4}\b", r"\b(?:Season|Staffel)\s*([0-9]{1,2})\b", r"\bS([0-9]{1,2})\b")
NO_EPISODES = (480, 576, 720, 1080, 2160, 264, 265)
# Remarks on videos in song titles, in brackets, behind a bar and at the end, and what names of channels hold.
BRACKETED = r"official[^)\]|]*|lyrics?(?: video)?|audio|visuali[sz]er|music video|video|mv|hd|hq|4k|ncs release|spotisaver"
BEHIND_BAR = r"ncs|copyright|release|lyrics?"
TRAILING = r"official music video|official video|official audio|mv"
CHANNELS = r"official|channel|vevo|records|recordings|music\b|sounds\b|nation\b|- topic"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _nothing(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def _untagged(name: Column) -> Column:
    return F.regexp_replace(name, r"\[[^\]]*\]|\([^)]*\)", " ")


def _first_mark(text: Column, marks: tuple[str, ...]) -> Column:
    return F.coalesce(*[_nothing(F.regexp_extract(text, f"(?iU){m}", 1)) for m in marks])


def episode_number(name: Column) -> Column:
    """The episode of a file name, its extension and what stands in brackets aside: the first mark that is there, else the last number of at most three digits that is no size of pictures; null without one."""

    def of(text: Column) -> Column:
        bare = F.filter(F.regexp_extract_all(text, F.lit("(?<![0-9x])([0-9]{1,3})(?![0-9p])"), F.lit(1)), lambda x: ~x.cast("int").isin(*NO_EPISODES))
        return F.coalesce(_first_mark(text, EPISODE_MARKS), F.get(bare, F.size(bare) - 1)).cast("int")

    return _let(_untagged(stem(name)), of)


def season_number(name: Column) -> Column:
    """The season that a name of a file or folder marks; null without a mark."""
    return _first_mark(name, SEASON_MARKS).cast("int")


def clean_title(name: Column) -> Column:
    """A folder's name as a title: without brackets and seasons, ``_`` and ``.`` as spaces; empty if nothing is left."""
    out = F.translate(_untagged(name), "_.", "  ")
    out = F.regexp_replace(out, r"(?iU)\b(?:Season|Staffel)\s*[0-9]{1,2}\b|\bS[0-9]{1,2}\b", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "), F.lit(" -"))


def guess_title(folder: Column, parent: Column, first: Column) -> Column:
    """The title of a season: the folder's name, else its parent's, else what its first file's name has before " - " or a mark, else the folder's as it is."""
    start = F.get(F.split(_untagged(stem(first)), r"\s-\s|\bS[0-9]{1,2}E[0-9]|\b[0-9]{1,2}x[0-9]", 2), F.lit(0))
    return F.coalesce(*[_nothing(clean_title(c)) for c in (folder, parent, start)], folder)


def artist_and_title(name: Column) -> list[Column]:
    """(artist, title) of a song's file name: a track number goes, and the first " - " parts them; without it the artist is null. ``_`` stands for a space where the name has none."""
    plain = stem(name)
    spaced = F.when(F.contains(plain, F.lit(" ")), plain).otherwise(F.replace(plain, F.lit("_"), F.lit(" ")))
    bare = F.coalesce(_nothing(_strip(F.regexp_replace(spaced, r"(?U)^[0-9]{1,3}[\s._-]+", ""))), spaced)
    parts = F.split(bare, " - ", 2)
    two = F.size(parts) == 2
    return [F.when(two, _nothing(_strip(parts[0]))), F.when(two, _strip(F.get(parts, F.lit(1)))).otherwise(bare)]


def song_title(title: Column) -> Column:
    """A song's title without remarks on its video and without quotes around it, until none is left; a title of nothing else stays.

    Every round beyond the second needs a bracket that the round before laid
    bare, so the title's brackets bound the rounds.
    """
    rules = ((rf"(?iU)\s*\|.*(?:{BEHIND_BAR}).*$", ""), (rf"(?iU)\s*[(\[【]\s*(?:{BRACKETED})\s*[)\]】]", ""), (rf"(?iU)(?:\s+(?:{TRAILING}))+$", ""))
    plain = _strip(title)
    rounds = F.sequence(F.lit(0), F.length(F.regexp_replace(plain, r"[^(\[【]", "")) + 1)
    once = lambda t, _: _strip(reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, t))
    unquoted = lambda t: F.when(F.length(t) > 2, _strip(F.regexp_replace(t, "^(?s)([\"'])(.*)\\1$", "$2"))).otherwise(t)
    return F.coalesce(_nothing(_let(F.aggregate(rounds, plain, once), unquoted)), plain)


def holds(text: Column, part: Column) -> Column:
    """Whether ``part`` stands in ``text`` as words of its own; case does not count."""
    literal = F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.rlike(text, F.concat(F.lit(r"(?iU)(?<!\w)"), literal, F.lit(r"(?!\w)")))


def song_name(artist: Column, title: Column) -> Column:
    """struct<artist, title> to show: a title that parts artist and title by a dash decides where the artist is missing, one of the two is in the other, or it names a channel."""

    def of(x: Column) -> Column:
        a, t = x["a"], x["t"]
        parts = F.transform(F.split(t, r"(?U)\s+[-–—]\s+", 2), _strip)
        first, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        own = F.coalesce((first != "") & (rest != ""), F.lit(False)) & (a.isNull() | holds(first, a) | holds(a, first) | F.rlike(a, F.lit(f"(?iU){CHANNELS}")))
        return F.when(own, F.struct(first.alias("artist"), song_title(rest).alias("title"))).otherwise(F.struct(a.alias("artist"), t.alias("title")))

    return _let(F.struct(_nothing(_strip(artist)).alias("a"), song_title(title).alias("t")), of)


def song_label(artist: Column, title: Column) -> Column:
    """``artist - title`` as ``song_name`` has them; the title alone if it holds the artist or there is none."""
    both = lambda n: F.when(n["artist"].isNull() | holds(n["title"], n["artist"]), n["title"]).otherwise(F.concat(n["artist"], F.lit(" - "), n["title"]))
    return _let(song_name(artist, title), both)
