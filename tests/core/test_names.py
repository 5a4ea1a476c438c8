"""Names of files, folders and songs, folders of episodes, and episodes after a look at their files."""

import pytest
from pyspark.sql import functions as F
from tessella.functions import names
from tessella.operators import stages
from tessella.sources import readers

FILES = {
    "[SubsPlease] Horimiya - 03 (1080p) [ABCD1234].mkv": 3, "Horimiya.S01E07.1080p.WEB.x264.mkv": 7, "Horimiya Episode 12.mp4": 12, "Horimiya_Folge_5.mkv": 5, "Horimiya E09 [720p].mkv": 9, "[Grp] Show - 11v2 [1080p].mkv": 11, "04.mkv": 4,
    "Horimiya - 01x02 - Unterschiedliche Gesichter.mp4": 2, "Horimiya - 01x13 - Wenigstens diesen weiten Himmel ....mp4": 13, "[Grp] Video 1920x1080 - 05.mkv": 5, "Movie.mkv": None, "": None, "Show 720.mkv": None, "Show 720 8.mkv": 8,
}
LABELS = [
    ("R2 ", "R2 - Blah Blah Blah (Official Visualiser)", "R2 - Blah Blah Blah"), ("SiM Official YouTube Channel", "SiM – The Rumbling (OFFICIAL VIDEO)", "SiM - The Rumbling"), ("NoCopyrightSounds", "Jim Yosef - Firefly | Melodic Dubstep | NCS - Copyright Free Music", "Jim Yosef - Firefly"),
    ("Ian Asher", "Ian Asher & Phantogram- Black Out Days (Official Audio)", "Ian Asher & Phantogram- Black Out Days"), ("makko", 'makko & Miksu/Macloud - "LICHTER AUS"', "makko & Miksu/Macloud - LICHTER AUS"), ("Ado", "【Ado】 唱", "【Ado】 唱"), ("Ado", "Shadow", "Ado - Shadow"),
    ("LiSA", "Gurenge - TV Size", "LiSA - Gurenge - TV Size"), (None, "song", "song"), ("  ", " song ", "song"), ("A.B (C)\\E", "A.B (C)\\E - x", "A.B (C)\\E - x"), ("x", "(Official Video)", "x - (Official Video)"), ("a", "t ( (HD) audio) [4k (official video)]", "a - t"), (None, "", ""),
]


def test_numbers_of_files(spark):
    df = spark.createDataFrame([(n,) for n in FILES], "name string")
    assert {r.name: r.n for r in df.select("name", names.episode_number(F.col("name")).alias("n")).collect()} == FILES


def test_seasons_and_titles(spark):
    one = lambda f, *a: spark.range(1).select(f(*[F.lit(x) for x in a])).first()[0]
    assert [one(names.season_number, n) for n in ("Horimiya Season 2", "Show.S03E01.mkv", "Horimiya", "Horimiya - 02x05 - Titel.mp4", "S1")] == [2, 3, None, 2, 1]
    assert [one(names.clean_title, n) for n in ("[Grp] Horimiya S01 (2021) [1080p]", "Kaguya-sama Season 2", "S1", "")] == ["Horimiya", "Kaguya-sama", "", ""]
    assert one(names.guess_title, "Season 1", "Staffel 2", "Horimiya - 01x01 - Titel.mp4") == "Horimiya" and one(names.guess_title, "S1", "", "S01E01.mkv") == "S1"


def test_artists_of_file_names(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["LiSA - Gurenge.mp3", "03 Gurenge.mp3", "LiSA_-_Gurenge.mp3", "2049.mp3", "01. A - B - C.flac", "12.mp3"])], "i int, name string")
    artist, title = names.artist_and_title(F.col("name"))
    assert [(r.t, r.a) for r in df.select("i", artist.alias("a"), title.alias("t")).orderBy("i").collect()] == [("Gurenge", "LiSA"), ("Gurenge", None), ("Gurenge", "LiSA"), ("2049", None), ("B - C", "A"), ("12", None)]


def test_labels_of_songs(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(LABELS)], "i int, artist string, title string, want string")
    got = df.select("i", "want", names.song_label(F.col("artist"), F.col("title")).alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]
    pairs = spark.createDataFrame([("NoCopyrightSounds", "DEAF KEV - Invincible [NCS Release]"), ("Chill Nation", "INTERWORLD - METAMORPHOSIS"), ("x", None)], "artist string, title string")
    assert [tuple(r.n) for r in pairs.select(names.song_name(F.col("artist"), F.col("title")).alias("n")).collect()] == [("DEAF KEV", "Invincible"), ("INTERWORLD", "METAMORPHOSIS"), ("x", None)]


def test_folders_are_seasons(spark, tmp_path):
    def folder(path, *files):
        (tmp_path / path).mkdir(parents=True)
        for f in files:
            (tmp_path / path / f).write_bytes(b"x")

    folder("Horimiya/S2", "Horimiya - 02x01 - A.mp4", "Horimiya - 02x02 - B.mp4", "notes.txt")
    folder("My Show (2020)", "a.mkv", "b 1.mkv", "c 3.mkv", "d 3.mkv", "e.mkv")
    got = {}
    for r in readers.episodes(spark, str(tmp_path), recursive=True).orderBy("name").collect():
        got.setdefault((r.title, r.season), []).append(r.number)
    # a takes place 1, so b is 2; d finds 3 taken and is 4, its place; e is 5.
    assert got == {("Horimiya", 2): [1, 2], ("My Show", 1): [1, 2, 3, 4, 5]}


STORED = "season int, number int, title string, filler boolean, recap boolean, source_id string, path string, size long, mtime long, skips string, scenes string"
FOUND = "season int, number int, title string, source_id string, path string, size long, mtime long"


@pytest.mark.parametrize("force", [False, True])
def test_prepared_episodes(spark, force):
    stored = spark.createDataFrame([(1, n, f"t{n}", False, None, "s", "p", 5, 5, "sk", None if n == 4 else "sc") for n in range(1, 7)], STORED)
    found = [(1, 1, None, None, "q", 5, 5), (1, 2, "new", "z", "q", 6, 5), (1, 3, None, None, None, None, None), (1, 4, None, None, None, None, None), (1, 7, None, None, "q", 1, 1), (1, 8, "gone", None, None, None, None)]
    meta = spark.createDataFrame([(1, 1, "m1", True, False), (1, 2, "m2", True, False), (1, 6, "m6", True, True), (1, 9, "m9", True, True)], "season int, number int, title string, filler boolean, recap boolean")
    out = stages.prepare_episodes(stored, spark.createDataFrame(found, FOUND), meta, "season", "number", ("skips", "scenes"), ("skips", "scenes"), force)
    got = {r.number: (r.title, r.filler, r.source_id, r.path, r.size, r.skips, r.scenes, r.work, r.open) for r in out.collect()}
    assert got == {
        1: ("m1", True, "s", "q", 5, None if force else "sk", "sc", "ready", force), 2: ("new", True, "z", "q", 6, None, None, "ready", True), 3: ("t3", False, "s", "p", 5, "sk", "sc", "missing" if force else "known", False),
        4: ("t4", False, "s", "p", 5, "sk", None, "missing", False), 5: ("t5", False, "s", "p", 5, "sk", "sc", None, False), 6: ("t6", False, "s", "p", 5, "sk", "sc", None, False), 7: (None, None, None, "q", 1, None, None, "ready", True),
    }
    assert stages.prepare_episodes(stored.where("false"), out.select(*FOUND.replace(" int", "").replace(" string", "").replace(" long", "").split(", ")).where("false"), meta, "season", "number", ("skips", "scenes"), ("skips", "scenes")).count() == 0
