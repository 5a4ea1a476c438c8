"""Readers: folders of media files, subtitle texts, tables with columns that older files lack."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.names import artist_and_title, episode_number, guess_title, season_number
from tessella.functions.text import spoken


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``; nullable columns that it lacks are null, others are an error."""
    for f in schema:
        if f.name not in df.columns and not f.nullable:
            raise ValueError(f"column {f.name} is missing and cannot be null")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """path, name, size and modification time of the files with one of the extensions; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    named = found.withColumn("name", F.url_decode(F.element_at(F.split("path", "/"), -1)))
    return named.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin([e.lower().lstrip(".") for e in extensions]))


def _numbered(files: pd.DataFrame) -> pd.DataFrame:
    """The files of one folder by name, each with its own number, or the first free one from its place on."""
    files, used, numbers = files.sort_values("name"), set(), []
    for place, number in enumerate(files["number"], start=1):
        if pd.isna(number) or number in used:
            number = next(n for n in range(place, place + len(used) + 1) if n not in used)
        used.add(int(number))
        numbers.append(int(number))
    first = files["name"].iloc[0]
    return files.assign(number=numbers, first=first)


def episodes(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("mkv", "mp4", "avi"), recursive: bool = False) -> DataFrame:
    """Episode files by folder, each of which is a season: ``folder, path, name, length, number, season, title``.

    Files are taken by name. A number that is missing or taken is replaced by
    the file's place in its folder, or the next free one. The season is what
    the folder's name marks, else the first file's, else 1; for the title see
    ``names.guess_title``. Folders are numbered side by side, and only the
    listing of one (no contents) is a task's.
    """
    f = files(spark, folder, extensions, recursive).select("path", "name", "length").withColumns({"folder": F.regexp_replace("path", "/[^/]*$", ""), "number": episode_number(F.col("name"))})
    numbered = f.groupBy("folder").applyInPandas(_numbered, "path string, name string, length long, folder string, number int, first string")
    last = lambda k: F.url_decode(F.coalesce(F.try_element_at(F.split("folder", "/"), F.lit(k)), F.lit("")))
    season = F.coalesce(season_number(last(-1)), season_number(F.col("first")), F.lit(1))
    return numbered.select("folder", "path", "name", "length", "number", season.alias("season"), guess_title(last(-1), last(-2), F.col("first")).alias("title"))


def songs(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("mp3", "flac", "ogg", "wav", "m4a")) -> DataFrame:
    """Song files below a folder with artist and title from their names."""
    artist, title = artist_and_title(F.col("name"))
    return files(spark, folder, extensions, recursive=True).select("path", "length", artist.alias("artist"), title.alias("title"))


_TIME = r"(?:(\d+):)?(\d\d):(\d\d)[.,](\d{1,3})"


def _seconds(mark: Column) -> Column:
    part = lambda k: F.regexp_extract(mark, _TIME, k)
    return F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double") + F.rpad(part(4), 3, "0").try_cast("double") / 1000


def subtitles(spark: SparkSession, path: str, skip_style: str = "(?i)sign|song|karaoke|op|ed") -> DataFrame:
    """Spoken lines of SRT, VTT and ASS files (path, start, end, text, by start): comments, signs, lyrics, positioned and bracketed lines are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    rows = raw.select("path", F.explode(F.split("value", "\n")).alias("line")).where("line like 'Dialogue:%'")
    cells = F.split(F.regexp_replace("line", "^Dialogue: *", ""), ",", 10)
    ass = rows.select("path", F.get(cells, F.lit(1)).alias("s"), F.get(cells, F.lit(2)).alias("e"), F.get(cells, F.lit(3)).alias("style"), F.regexp_replace(F.get(cells, F.lit(9)), r"\\[Nn]", " ").alias("text"))
    blocks = raw.where("value not like '%Dialogue:%'").select("path", F.explode(F.split("value", "\n\n+")).alias("block"))
    mark = F.regexp_extract("block", rf"{_TIME} *--> *{_TIME}", 0)
    srt = blocks.where(mark != "").select(
        "path", F.split(mark, "-->")[0].alias("s"), F.split(mark, "-->")[1].alias("e"), F.lit("").alias("style"),
        F.regexp_replace(F.regexp_replace("block", rf"(?s)^.*?{_TIME} *--> *{_TIME}[^\n]*\n?", ""), r"<[^>]*>|\n", " ").alias("text"),
    )
    both = ass.unionByName(srt).where(spoken(F.col("text")) & ~F.rlike("style", F.lit(rf"^(?:{skip_style})")))
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"\{[^}]*\}", ""), " +", " "))
    return both.select("path", F.round(_seconds(F.col("s")), 3).alias("start"), F.round(_seconds(F.col("e")), 3).alias("end"), plain.alias("text"))
