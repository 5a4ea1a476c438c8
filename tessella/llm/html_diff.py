"""Main text of web pages by differencing each page with its nearest neighbours by URL.

Every page becomes a row of text lines (one for each block of the markup).
Within a host the pages stand in the order of their URL paths, copies of a
page (equal lines) as one; a page is paired with the page before and the page
after it. The lines of a pair are aligned by a longest common subsequence over
their hashes, and lines that both pages have are the host's furniture: they
are deleted. The markup protects the lines of the page's article, since
articles too repeat passages, and only where no neighbour shares a line it
decides alone: what it names as furniture (menus, footers, forms, adverts,
comments) goes, as does text beside an article that is most of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, neighbours, text_id, written

# Elements and words of HTML. -----------------------------------------------------------------------------
#: Elements whose content is never text of the page.
SILENT = "script style noscript template iframe svg canvas select textarea title datalist".split()
#: Elements that are furniture wherever they stand.
FURNITURE = "nav footer aside form menu dialog button".split()
#: Elements that start a new block.
BLOCKS = (
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
#: Blocks that nest; their end tags close what is still open inside.
NESTED = (
    "address article aside blockquote body details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table ul button"
).split()
#: Blocks that another block of any kind ends.
LEAVES = "p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre figcaption caption legend summary option".split()
#: Class and id names that mark furniture, whole or as the first part of a name.
NAMES = (
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead topbar footer sidebar aside rail widget related recommended share sharing social newsletter subscribe subscription "
    "signup login cookie cookies consent notice notices gdpr popup modal overlay alert comment comments reply replies respond disqus "
    "pagination pager skip copyright toolbar"
).split()
#: Those of them that do so inside an article too.
INSIDE = "ad ads adsense advert adverts advertisement advertising sponsored promo newsletter comment comments disqus share sharing".split()
#: Last parts of names that mark what readers write, wherever it stands; not after these first parts, which are of pages that have it.
READERS, HAVING = "comment comments reply replies response responses disqus discussion".split(), "has have with no without show hide".split()
#: ARIA roles that mark furniture.
ROLES = "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
# -------------------------------------------------------------------------------------------------------------------------

PLAIN, ARTICLE, LINKS, DROPPED = 0, 1, 2, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s>/])[^>]*(?:>.*?(?:</(?P=silent)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s>/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SETS = {k: frozenset(v) for k, v in (("furniture", FURNITURE), ("blocks", BLOCKS), ("nested", NESTED), ("leaves", LEAVES), ("names", NAMES), ("inside", INSIDE), ("roles", ROLES), ("readers", READERS), ("having", HAVING))}


def _marked(attrs: str, names: str = "names") -> bool:
    """Whether attributes mark an element as furniture, by their own ``names`` among others."""
    if len(attrs) < 4:
        return False
    if _HIDDEN.search(attrs):
        return True
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values).lower()
        if name.lower() in ("class", "id") and any(w in _SETS[names] or _WORD.match(w) and _WORD.match(w)[0] in _SETS[names] for w in value.split()):
            return True
        if name.lower() in ("class", "id") and any(_of_readers(w) for w in value.split()):
            return True
        if name.lower() == "role" and value.strip() in _SETS["roles"]:
            return True
    return False


def _of_readers(name: str) -> bool:
    """Whether a name such as ``reader-responses`` or ``post_comments`` is of what readers write."""
    parts = _WORD.findall(name)
    return len(parts) > 1 and parts[-1] in _SETS["readers"] and parts[0] not in _SETS["having"]


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """The text lines of a page in order, and what the markup says of each: PLAIN, ARTICLE, LINKS (most of it is link text) or DROPPED."""
    lines: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, article
    parts: list[str] = []
    state = {"linked": 0, "link": 0}

    def close() -> None:
        line = " ".join(entities.unescape("".join(parts)).split())
        linked, state["linked"] = state["linked"], 0
        parts.clear()
        if line:
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            lines.append(line)
            kinds.append(DROPPED if dropped else LINKS if 2 * linked > len(line) else ARTICLE if article else PLAIN)

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if state["link"]:
                state["linked"] += len(piece)

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            state["link"] = 0 if m["end"] else 1
        if tag not in _SETS["blocks"] and tag != "button":
            continue
        close()
        if tag in ("br", "hr"):
            continue
        if stack and stack[-1][0] in _SETS["leaves"] and (not m["end"] or stack[-1][0] == tag or tag in _SETS["nested"]):
            stack.pop()
        if m["end"]:
            if tag in _SETS["nested"] and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        own = m["attrs"] or ""
        wrapper = tag == "form" and not lines and all(x[0] in ("html", "body", "div") for x in stack)  # a form around the whole page
        inside = article or tag in ("article", "main") or "main" in own and bool(re.search(r"""role\s*=\s*["']?main""", own, re.I))
        furniture = tag in _SETS["furniture"] and not wrapper or tag == "header" and not article
        furniture = furniture or tag not in ("html", "body", "article", "main") and not wrapper and _marked(own, "inside" if article else "names")
        if inside and not article:  # an article is none of the furniture around it
            dropped = False
        if tag in _SETS["nested"] or tag in _SETS["leaves"]:
            stack.append((tag, dropped or furniture, inside))
    text(page[at:])
    close()
    return lines, kinds


def _lcs_rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel longest common subsequence: after each of ``a``, a 0 bit wherever the length grows along ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v, rows = ones, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & ones
        rows.append(v)
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    """Common length with each prefix of ``b``, from the empty one."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes of ``a`` in one longest common subsequence with ``b``. Exact at any length; memory stays bounded by halving long inputs."""
    out: list[int] = []

    def walk(lo: int, hi: int, left: int, right: int) -> None:
        while lo < hi and left < right and a[lo] == b[left]:
            out.append(lo)
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            out.append(hi)
        if lo >= hi or left >= right:
            return
        if (hi - lo) * (right - left) <= 1 << 26 or hi - lo == 1:
            rows, j = _lcs_rows(a[lo:hi], b[left:right]), right - left
            full = (1 << (right - left)) - 1
            for i in range(hi - lo - 1, -1, -1):
                above = rows[i - 1] if i else full
                here, up = (~rows[i] & (1 << j) - 1).bit_count(), (~above & (1 << j) - 1).bit_count()
                if here > up:  # this line is matched, to the last place where the length is still reached
                    while j and not ~rows[i] >> (j - 1) & 1:
                        j -= 1
                    out.append(lo + i)
                    j -= 1
            return
        mid, n = (lo + hi) // 2, right - left
        first = _lengths(_lcs_rows(a[lo:mid], b[left:right])[-1], n)
        last = _lengths(_lcs_rows(a[mid:hi][::-1], b[left:right][::-1])[-1], n)[::-1]
        cut = left + int(np.argmax(first + last))
        walk(lo, mid, left, cut)
        walk(mid, hi, cut, right)

    walk(0, len(a), 0, len(b))
    return sorted(out)


def decided(kinds: list[int], sizes: list[int]) -> list[int]:
    """What each line is if no neighbour shares it: kept (1) or not. Beside an article that is most of a page's text, plain lines go."""
    of = lambda kind: sum(n for k, n in zip(kinds, sizes) if k == kind)
    fixed = ARTICLE in kinds and of(ARTICLE) >= of(PLAIN)
    return [int(k != DROPPED and not (fixed and k == PLAIN)) for k in kinds]


def shared_with_neighbours(own: list[int], others: list[list[int]]) -> list[int]:
    """Lines that a page shares with any of its neighbours, in order."""
    shared: set[int] = set()
    for other in others:
        known = set(other)
        same = [i for i, x in enumerate(own) if x in known]
        mine = set(own)
        lines = common_lines([own[i] for i in same], [x for x in other if x in mine])
        found = [same[i] for i in lines]
        shared.update(found)
    return sorted(shared)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``lines_deleted`` for every row of ``pages``.

    The text is the page's remaining lines in order, joined by one space:
    character references decoded, white space turned into single spaces.
    Without any line it is empty. ``lines_deleted`` counts what the
    differencing took.

    Null pages have an empty text; a null URL is an empty host and path. Where
    rows share an id, each is extracted from its own page and the page with
    the least URL stands for them among the neighbours. Ties in the URL are
    ordered by id. Of pages with equal lines in one host the first stands for
    all, so copies are no evidence against each other and have the same
    neighbours. An empty table gives an empty result. Further columns are not
    looked at.
    """
    bounded_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        text_id(id_col).alias("id"), F.col(id_col).alias("own_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "")

    def hashed(lines: list[str]) -> list[int]:
        return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, asked = [], []
            for page in b.column(3):
                lines, kinds = page_lines(page.as_py())
                hashes.append(hashed(lines))
                asked.append([i for i, k in enumerate(kinds) if k != ARTICLE])
            whole = pa.array([hash_list(h) for h in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], whole, pa.array(hashes, pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int32()))], ["id", "host", "path", "outline", "hashes", "asked"])

    placed = rows.select("id", host.alias("host"), path.alias("path"), "html")
    outlines = written(placed.mapInArrow(outline, "id long, host string, path string, outline long, hashes array<long>, asked array<int>"), "outlines")
    one = written(outlines.groupBy("host", "outline").agg(F.min(F.struct("path", "id", "hashes", "asked")).alias("o")).select("host", "outline", "o.path", "o.id", "o.hashes", "o.asked"), "distinct")
    order = neighbours(one.select("host", "path", "id", "outline"), [F.col("host"), F.col("path"), F.col("id"), F.col("outline")], ["host", "outline"])
    beside = F.filter(F.array("_prev", "_next"), lambda x: x["host"] == F.col("host"))
    pairs = order.select("host", "outline", F.explode(beside).alias("n")).select("host", "outline", F.col("n.outline").alias("other"))
    others = pairs.join(one.select("host", F.col("outline").alias("other"), F.col("hashes").alias("theirs")), ["host", "other"]).groupBy("host", "outline").agg(F.collect_list("theirs").alias("others"))
    asking = one.where(F.size("asked") > 0).join(others, ["host", "outline"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [sorted({*asked} & {*shared_with_neighbours(hashes, near)}) for hashes, asked, near in zip(*(b.column(c).to_pylist() for c in ("hashes", "asked", "others")))]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("outline"), pa.array(gone, pa.list_(pa.int32()))], ["host", "outline", "gone"])

    shared = asking.select("host", "outline", "hashes", "asked", "others").mapInArrow(differ, "host string, outline long, gone array<int>")
    shared = written(shared.where(F.size("gone") > 0), "decided")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept, outlines_ = [], [], []
            for page in b.column(3):
                found, marks = page_lines(page.as_py())
                outlines_.append(hash_list(hashed(found)))
                texts.append(found)
                kept.append(decided(marks, [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(texts, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.int32())), pa.array(outlines_, pa.int64())],
                ["own_id", "url", "host", "lines", "kept", "outline"],
            )

    parsed = rows.select("own_id", "url", host.alias("host"), "html").mapInArrow(lines, f"own_id {kind}, url string, host string, lines array<string>, kept array<int>, outline long")
    out = parsed.join(shared, ["host", "outline"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter("lines", lambda x, i: (F.get(F.col("kept"), i) == 1) & ~F.array_contains(gone, i))
    return out.select(F.col("own_id").alias(id_col), F.col("url").alias(url_col), F.array_join(kept, " ").alias("text"), F.size(gone).alias("lines_deleted"))


def hash_list(hashes: list[int]) -> int:
    """One signed hash of a page's line hashes, to tell rows of one id apart."""
    return xxhash.xxh64_intdigest(np.array(hashes, np.int64).tobytes()) - (1 << 63)
