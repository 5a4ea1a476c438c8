"""Packing token sequences by bounded-space online best fit.

Every task packs the documents that it reads, in order: a fixed number of bins
is open, kept in lists by free space, with a bitset of the free spaces that
occur. A piece goes to the open bin with the least free space that holds it;
where none does, a new bin is opened, and if too many are open, the fullest is
closed. Placements are given out at once, so a task holds nothing but its open
bins' numbers. Nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import bounded_batches

#: Tokens of a sequence, bins that a task keeps open, and the id after each document.
CAPACITY, OPEN_BINS, END_ID = 4096, 256, 1
#: Words whose ids a worker keeps (and as many runs of letters), and their longest length in bytes: some 120 MB at most.
KEPT_WORDS, KEPT_LENGTH = 400_000, 32
#: Characters of a long text that are worked on at a time.
CHARACTERS_AT_ONCE = 1 << 18
#: Words of short texts that are looked up together.
WORDS_AT_ONCE = 20_000
#: Pieces in one batch of rows out.
BATCH = 1024


class BestFit:
    """Places lengths into bins of a capacity, at most ``open_bins`` of them open at any time."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.bins = 0

    def _take(self, space: int) -> int:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of that length."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.bins
            self.bins += 1
        rest = space - length
        if rest:
            self.free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - space


#: A word a line. Words whose ids follow from those of a run of letters and of the marks behind it, in either case, have two groups: Latin letters, ASCII
#: marks but the apostrophe. All others have one.
_WORDS = re.compile(r"(?m)^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)|(.+))$")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, word by word, for a tokenizer that lower-cases, splits letters from marks, and drops white space.

    The ids of short words are kept, up to ``kept_words``; then all are
    dropped. What a group of texts has of new words is encoded at once; of a
    word of letters and marks behind them, only the letters in lower case have
    to be new.
    """

    def __init__(self, tokenizer_file: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokenizer_file), kept_words
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, runs: set[str]) -> dict[str, bytes]:
        """The ids of runs of lower-case letters or of marks; those that were not known are kept, if they are short."""
        new = [r for r in runs if r not in self.runs]
        made = dict.fromkeys(runs.difference(new))
        for r in made:
            made[r] = self.runs[r]
        letters = [r for r in new if r.isalpha()]
        ids, of = (), ()
        if letters:
            encoded = self.tokenizer.encode(" ".join(letters), add_special_tokens=False)
            ids, of = np.array(encoded.ids, "<u4"), np.array(encoded.word_ids)
        cuts = np.flatnonzero(np.diff(of)) + 1
        if letters and len(cuts) == len(letters) - 1:
            data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            made.update(zip(letters, (data[i:j] for i, j in zip([0, *ends], ends))))
        for r in new:
            if r not in made:
                made[r] = self.one(r)
        if len(self.runs) + len(new) > self.most:
            self.runs = {"": b""}
        self.runs.update((r, made[r]) for r in new if len(r) <= KEPT_LENGTH)
        return made

    def learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words, which are kept, if they are short."""
        lines = _WORDS.findall(b"\n".join(missing).decode("utf-8", "surrogatepass"))
        lower = [(run.lower(), marks) for run, marks, _ in lines]
        known = self._runs({r for both in lower for r in both})
        out = {w: self.one(line[2]) if line[2] else known[run] + known[marks] for w, line, (run, marks) in zip(missing, lines, lower)}
        if len(self.words) + len(out) > self.most:
            self.words = {}
        self.words.update((w, x) for w, x in out.items() if len(w) <= KEPT_LENGTH)
        return out

    def encode_all(self, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words."""
        found = [list(map(self.words.get, words)) for words in lists]
        missing = {w for words, ids in zip(lists, found) if None in ids for w, x in zip(words, ids) if x is None}
        if missing:
            new = self.learn(list(missing))
            found = [[new[w] if x is None else x for w, x in zip(words, ids)] if None in ids else ids for words, ids in zip(lists, found)]
        return list(map(b"".join, found))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.encode_all(list(word_lists(text))))


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text as UTF-8, ``CHARACTERS_AT_ONCE`` at a time; the text is cut at white space only. At least one list."""
    at, text = 0, text or ""
    while True:
        cut = _SPACE.search(text, at + CHARACTERS_AT_ONCE)
        yield text[at : cut.start() if cut else len(text)].encode("utf-8", "surrogatepass").split()
        if not cut:
            return
        at = cut.start()


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str, kept_words: int) -> WordIds:
    return WordIds(tokenizer_file, kept_words)


def pack(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID,
    with_ids: bool = False, kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """One row for each piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and with ``with_ids`` also ``ids`` (binary, little-endian 32 bit).

    A document is its token ids and ``end_id``. Longer ones than ``capacity``
    are cut into pieces of that many; shorter ones never. Null and empty texts
    are ``end_id`` alone. Repeated rows are documents of their own, null ids
    are kept, an empty table gives no pieces; further columns are not looked
    at, whatever their names. A very long text is encoded and given out part
    by part; of its ids a task holds ``CHARACTERS_AT_ONCE`` characters' and one
    piece. Sequence numbers are unique, not dense. Which pieces share a
    sequence depends on the partitioning. ``kept_words`` bounds the words whose
    ids a worker keeps: fewer take less memory and more time, with equal
    results. ``tokenizer_file`` has to be on every machine, and its tokenizer
    has to drop white space.
    """
    bounded_batches(docs.sparkSession)
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()][: len(names)]
    last, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, bins = word_ids(tokenizer_file, kept_words), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            rows: list[tuple] = []
            for of, n, part in pieces(vocabulary, b.column(1)):
                number, offset = bins.place(len(part) // 4)
                rows.append((of, n, n * capacity, len(part) // 4, zlib.crc32(part), base | number, offset, *([part] if with_ids else [])))
                if len(rows) >= BATCH:
                    yield batch(b.column(0), rows)
                    rows = []
            if rows:
                yield batch(b.column(0), rows)

    def pieces(vocabulary: WordIds, texts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
        """(row, number of the piece, its ids), row after row."""
        lists: list[list[bytes]] = []
        of: list[int] = []  # rows; an empty list of row -1 - i ends row i
        size = n = 0
        rest = b""
        for i in range(len(texts)):
            for words in word_lists(texts[i].as_py()):
                lists.append(words)
                of.append(i)
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    rest, n = yield from cut(vocabulary.encode_all(lists), of, rest, n)
                    lists, of, size = [], [], 0
            lists.append([])
            of.append(-1 - i)
        yield from cut(vocabulary.encode_all(lists), of, rest, n)

    def cut(encoded: list[bytes], of: list[int], rest: bytes, n: int) -> Iterator[tuple[int, int, bytes]]:
        for ids, i in zip(encoded, of):
            data = rest + (last if i < 0 else ids)
            end = len(data) if i < 0 else len(data) - len(data) % width
            for at in range(0, end, width):
                yield (-1 - i if i < 0 else i), n, data[at : at + width]
                n += 1
            rest, n = (b"", 0) if i < 0 else (data[end:], n)
        return rest, n

    def batch(ids_in: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        of, *columns = zip(*rows)
        return pa.RecordBatch.from_arrays([ids_in.take(pa.array(of)), *(pa.array(v, k) for v, k in zip(columns, kinds))], ["id", *names])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    for name, kind in zip(names, [T.IntegerType(), *[T.LongType()] * 5, T.BinaryType()]):
        out = out.add(name, kind)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)
