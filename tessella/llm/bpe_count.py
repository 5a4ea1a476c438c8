"""Token counts by byte-pair merging over a heap and a linked list.

The count of a text is its initial symbols less the merges made; no token ids
are produced. The text is first cut where no piece of the vocabulary can reach
across, so that each part merges by itself, and the counts of parts are kept
in a table of bounded size in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches

#: Parts of texts whose counts a worker keeps.
KEPT_PARTS = 400_000
_SPACE = "▁"


class MergeCounter(dict):
    """Counts for one sentencepiece BPE model with byte fallback and identity normalisation.

    A dict of part to count; a part that is missing is cut again between
    characters that stand side by side in no piece, and what is new among
    these is merged. When half of ``KEPT_PARTS`` are known, they become the
    older half, from which parts in use are taken over. ``count`` counts a text.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        scores = sorted({p.get_score(i) for i in usable}, reverse=True)
        level = {s: r for r, s in enumerate(scores)}
        self.rank = {p.id_to_piece(i): level[p.get_score(i)] for i in usable}
        self.joined = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        inside = any(_SPACE in piece.lstrip(_SPACE) for piece in self.rank)
        self.part = re.compile(r"(?s).+" if inside else f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+$")
        self.older: dict[str, int] = {}

    def __missing__(self, part: str) -> int:
        n = self.older.get(part)
        if n is None:
            joined, pairs = self.joined, map(str.__add__, part, part[1:])
            cuts = [i for i, pair in enumerate(pairs, 1) if pair not in joined]
            if not cuts:
                n = self.merged(part)
            else:
                n = sum(self[part[i:j]] for i, j in zip([0, *cuts], [*cuts, len(part)]))
        if len(part) <= 64:
            if len(self) >= KEPT_PARTS // 2:
                self.older = dict(self)
                self.clear()
            self[part] = n
        return n

    def merged(self, part: str) -> int:
        """Symbols of ``part`` less merges. A heap holds the adjacent pairs that make a piece, by rank and place; symbols are linked by their neighbours."""
        rank = self.rank
        sym: list[str | None] = list(part)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            a = sym[i]
            if a is None or (j := right[i]) < 0 or len(a) + len(sym[j]) != size:
                continue  # one of the two has been merged since
            sym[i] = a = a + sym[j]
            sym[j] = None
            merges += 1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get(a + sym[k])) is not None:
                    heappush(heap, (r, i, size + len(sym[k])))
            h = left[i]
            if h >= 0 and (r := rank.get(sym[h] + a)) is not None:
                heappush(heap, (r, h, len(sym[h]) + size))
        unknown = sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in sym if s is not None and s not in rank)
        return n - merges + unknown  # a symbol without a piece is one of its bytes each

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.part.findall(_SPACE + text.replace(" ", _SPACE))))


@lru_cache(maxsize=2)
def counter(model_file: str) -> MergeCounter:
    return MergeCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row.

    Null and empty texts have no tokens. Repeated rows give equal results,
    null ids are kept, an empty table gives none; further columns are not
    looked at. ``model_file`` has to be on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for b in batches:
            texts = b.column(1)
            sizes = [0 if t.as_py() is None else t.as_buffer().size for t in texts]
            counts = [c.count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [b.schema.names[0], "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
