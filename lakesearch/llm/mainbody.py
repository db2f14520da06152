"""The main body of a page, without menus, notices, bylines, teasers and footers.

Line-block distribution: markup is stripped, a line weighs the length of its running text, and the weights are summed
over a sliding window of lines. Where the sum surges the body begins, where it dives for good it ends, and what stands
between is kept.

Furniture inside that range is known by what the distribution shows of the whole collection: a first pass takes the
surge and dive points of each page and counts, for every form of line, how often it stands outside them and how often
between. Forms are the line itself, its beginning and its end, with numbers and names left out. A form that stands
outside far more often than inside is furniture wherever it stands, and weighs nothing in the second pass. There are no
word lists.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.stuffing import is_heap
from lakesearch.sources.shared import materialize
from lakesearch.sources.workers import ship, spread

#: Lines a window spans, and the sum of weights that counts as a surge.
WINDOW, SURGE = 3, 60
#: Running text ends like a sentence and has so many characters (Chinese ones count twice), or it is a paragraph.
SENTENCE, PARAGRAPH = 40, 120
#: A line is furniture if its form stands outside of bodies at such a part of its places; the lower value next to furniture.
OUTSIDE, OUTSIDE_NEAR = 0.7, 0.5
#: A whole line says something from so many places, a beginning or an end of lines from so many.
LEAST_WHOLE, LEAST_PART = 4, 8
#: A paragraph that stands in so many bodies with other beginnings is a notice (a refetched page has one beginning).
COPIES = 6
#: Forms that make up one in MOST of all go to every task, so at most MOST do: 300 000 of 10 bytes. All others are joined.
MOST = 300_000

_HAN = "一-鿿"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+(?:['’-][^\W\d_{_HAN}]+)*|\d+|[^\w\s]")
_HAN_ONE = re.compile(f"[{_HAN}]")
_END = re.compile(r"[.!?…。！？][\"”»’」』)\]]*$|[;:,；：，]$")
_TAGS = re.compile(r"</?[a-zA-Z!][^<>]*>")
_LINKS = re.compile(r"<a\b[^<>]*>.*?</a>", re.IGNORECASE)


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def plain(line: str) -> tuple[str, int]:
    """(visible text, its width without the text of links); a Chinese character is two wide."""
    linked = 0
    if "<" in line:
        linked = sum(len(_TAGS.sub("", x)) for x in _LINKS.findall(line))
        line = _TAGS.sub(" ", line)
    if "&" in line:
        line = html.unescape(line)
    line = line.replace("\xa0", " ").strip()
    return line, max(0, len(line) + (0 if line.isascii() else len(_HAN_ONE.findall(line))) - linked)


def forms(line: str) -> tuple[int, int, int]:
    """Hashes of the line, its beginning and its end, numbers as 0 and capitalised words inside as X."""
    out: list[str] = []
    for i, t in enumerate(_TOKEN.findall(line)):
        if t[0].isdigit():
            t = "0"
        elif i and t[0].isupper():
            if out[-1] == "X":
                continue
            t = "X"
        else:
            t = t.lower()
        out.append(t)
    n = 4 if any("一" <= t <= "鿿" for t in out) else 2
    return _hash("=" + " ".join(out)), _hash("^" + " ".join(out[:n])), _hash("$" + " ".join(out[-n:]))


def _page(text: str) -> tuple[list[int], list[str], list[int]]:
    """(places from 0, visible texts, widths) of the lines that aren't blank."""
    at, lines, widths = [], [], []
    for i, raw in enumerate(text.split("\n")):
        line, width = plain(raw)
        if line:
            at.append(i)
            lines.append(line)
            widths.append(width)
    return at, lines, widths


def observe(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(form, outside, inside, bit) of a page's lines, from surge and dive alone.

    Paragraphs make the body here. Lines before the first and after the last are outside; a line right above the first
    may be its heading and doesn't count. Between paragraphs a single line, and the last of several, is inside; the
    others may be teasers and don't count. `bit` marks one of 64 classes of page beginnings under a paragraph's form.
    """
    _, lines, widths = _page(text)
    core = [i for i, w in enumerate(widths) if w >= PARAGRAPH]
    if not core:
        return
    first, last, n = core[0], core[-1], len(lines)
    i = 0
    while i < n:
        j = i + 1
        if widths[i] >= PARAGRAPH:
            other = first if i != first else core[1] if len(core) > 1 else n - 1
            yield _hash("=" + lines[i]), 0, 0, 1 << (_hash(lines[other][:200]) & 63)
        else:
            while j < n and widths[j] < PARAGRAPH:
                j += 1
            for k in range(i, j):
                inside = k == j - 1
                if i > last or j <= first and not inside:
                    for f in forms(lines[k]):
                        yield f, 1, 0, 0
                elif j > first and inside:
                    for f in forms(lines[k]):
                        yield f, 0, 1, 0
        i = j


def _said(outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """(percent outside, weight) of forms by their places."""
    total = outside + inside
    # few places say little: a part of a line needs more of them than a whole line, which `Votes` asks for
    percent = np.where(total == 0, 100, np.round((outside + 0.5) * 100 / (total + 1))).astype(np.uint8)
    return np.stack([percent, np.minimum(np.where(total == 0, COPIES, total), 255).astype(np.uint8)])


def learned(df: DataFrame, body: str) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """What the surge and dive points of all pages say about each form that recurs: (forms ascending, percent outside and
    weight) of the most frequent ones, and a table (form, outside, inside) of all others, None if there are none.

    Counted by Spark with partial sums in Python and before the shuffle. What reaches the driver is bounded by MOST.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, list[int]] = {}
            for text in batch.column(0).to_pylist():
                for form, outside, inside, bit in observe(text) if text else ():
                    s = sums.setdefault(form, [0, 0, 0])
                    s[0] += outside
                    s[1] += inside
                    s[2] |= bit
            values = np.array([[f, o, i, b - (1 << 64) if b >> 63 else b] for f, (o, i, b) in sums.items()], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(values[:, c]) for c in range(4)], names=["form", "outside", "inside", "bits"])

    ship(df.sparkSession)
    seen = spread(df.select(F.col(body).alias("body"))).mapInArrow(run, "form bigint, outside bigint, inside bigint, bits bigint")
    counts = seen.groupBy("form").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"), F.bit_count(F.bit_or("bits")).alias("copies"))
    n = F.greatest(F.col("outside") + F.col("inside"), F.col("copies"))
    counts = counts.select("form", "outside", "inside", n.alias("n")).where((F.col("outside") + F.col("inside") >= LEAST_WHOLE) | (F.col("copies") >= COPIES))
    # no more than MOST forms can make up one in MOST of all, so nothing is sorted
    counts = materialize(counts, "forms")
    seen_all, least = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.min("n"), F.lit(0))).first()
    top = counts.where(F.col("n") * MOST >= seen_all).toArrow()
    form, outside, inside = (top.column(c).to_numpy() for c in ("form", "outside", "inside"))
    order = np.argsort(form)
    rest = counts.where(F.col("n") * MOST < seen_all).select("form", "outside", "inside") if least * MOST < seen_all else None
    return form[order], _said(outside, inside)[:, order], rest


class Votes:
    """How far outside of bodies a line's form stands, 0 to 1, or None where nothing is known.

    `known` holds the forms that every task has, `page` those that were looked up for the page at hand.
    """

    def __init__(self, form: np.ndarray, said: np.ndarray):
        self.known = self._of(form, said)
        self.page: dict[int, tuple[int, int]] = {}

    @staticmethod
    def _of(form: np.ndarray, said: np.ndarray) -> dict[int, tuple[int, int]]:
        return dict(zip(form.tolist(), zip(said[0].tolist(), said[1].tolist(), strict=True), strict=True))

    def turn(self, form: np.ndarray, said: np.ndarray) -> None:
        """To the next page, with what was looked up for it."""
        self.page = self._of(form, said)

    def unknown(self, text: str) -> set[int]:
        """Forms of a page's lines that have to be looked up."""
        out: set[int] = set()
        _, lines, widths = _page(text)
        for line, width in zip(lines, widths, strict=True):
            asked = (_hash("=" + line),) if width >= PARAGRAPH else forms(line)
            if asked[0] not in self.known:  # else its parts are not asked for
                out.update(f for f in asked if f not in self.known)
        return out

    def _find(self, form: int) -> tuple[int, int] | None:
        return self.known.get(form) or self.page.get(form)

    def __call__(self, line: str, width: int) -> float | None:
        if width >= PARAGRAPH:
            found = self._find(_hash("=" + line))
            return found[0] / 100 if found else None
        whole, *parts = forms(line)
        if found := self._find(whole):
            return found[0] / 100
        known = [x[0] for p in parts if (x := self._find(p)) and x[1] >= LEAST_PART]
        return sum(known) / len(known) / 100 if known else None


def furniture(text: str, votes: Votes) -> list[int] | None:
    """Numbers (from 1) of a page's lines that aren't its body, blank ones left out; None if no body is found."""
    at, lines, widths = _page(text)
    n = len(at)
    said = [votes(x, w) for x, w in zip(lines, widths, strict=True)]
    out = [v is not None and v >= OUTSIDE for v in said]
    running = [not o and (w >= PARAGRAPH or w >= SENTENCE and bool(_END.search(x))) for o, w, x in zip(out, widths, lines, strict=True)]
    weight = [0 if o else w if r else w // 3 for o, r, w in zip(out, running, widths, strict=True)]
    sums = [sum(weight[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]) for i in range(n)]
    dense = [i for i in range(n) if running[i] and sums[i] >= SURGE]
    if not dense:
        return None
    surge, dive = dense[0], dense[-1]
    # headings above the block, which must be known as some
    while surge > 0 and not out[surge - 1] and said[surge - 1] is not None and (said[surge - 1] < OUTSIDE_NEAR or running[surge]):
        surge -= 1
    # a list or verse may end a body; a lone short line after it is no part of it
    tail = dive
    while tail + 1 < n and not out[tail + 1]:
        tail += 1
    if tail - dive >= 2:
        dive = tail
    gone = [o or not surge <= i <= dive for i, o in enumerate(out)]
    # furniture comes in blocks: a short line beside it needs less to be taken for it, and an unknown one behind it is
    for i in range(surge, dive + 1):
        if not gone[i] and not running[i]:
            v, heading = said[i], i < dive and running[i + 1]
            near = i > 0 and gone[i - 1] or i + 1 < n and out[i + 1]
            gone[i] = near and not heading and v >= OUTSIDE_NEAR if v is not None else i > 0 and gone[i - 1]
    return [at[i] + 1 for i in range(n) if gone[i]]


def _looked_up(pages: DataFrame, table: Broadcast, rest: DataFrame) -> DataFrame:
    """`pages` (page, body, ...) with `said`, a list of (form, outside, inside) of the page's forms that are in `rest`, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(*table.value)
        for batch in batches:
            found = [(p, votes.unknown(b)) for p, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) if b]
            sizes = [len(f) for _, f in found]
            page = np.repeat(np.array([p for p, _ in found], np.int64), sizes)
            form = np.fromiter((x for _, f in found for x in f), np.int64, sum(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(form), pa.array(page)], names=["form", "page"])

    asked = pages.select("page", "body").mapInArrow(run, "form bigint, page bigint")
    # equal rows ask the same, so `page` needs no more than to be the same each time a row is read
    said = asked.join(rest, "form").groupBy("page").agg(F.collect_set(F.struct("form", "outside", "inside")).alias("said"))
    return pages.join(materialize(said, "said"), "page", "left")


def _pages(df: DataFrame, record: str, title: str, body: str, links: str, out: str, schema: str) -> DataFrame:
    spark = df.sparkSession
    *top, rest = learned(df, body)
    joined = rest is not None
    table = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(*table.value)
        for batch in batches:
            docs, titles, bodies, counts = (batch.column(c).to_pylist() for c in ("doc_id", "title", "body", "links"))
            if joined:
                said = batch.column("said")
                ends = said.offsets.to_numpy()
                form, outside, inside = (said.values.field(i).to_numpy() for i in range(3))
                values_of = _said(outside, inside)
            ids: list[int] = []
            values: list = []
            for row, (doc, t, b, n) in enumerate(zip(docs, titles, bodies, counts, strict=True)):
                if not b or not b.strip() or is_heap(t, b, n):
                    continue
                if joined:
                    part = slice(ends[row], ends[row + 1])
                    votes.turn(form[part], values_of[:, part])
                gone = furniture(b, votes)
                if gone is None:
                    continue
                if out == "line_no":
                    ids.extend([doc] * len(gone))
                    values.extend(gone)
                else:
                    drop = set(gone)
                    ids.append(doc)
                    values.append("\n".join(x for i, x in enumerate(b.split("\n"), 1) if i not in drop and x.strip()))
            kind = pa.int32() if out == "line_no" else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, kind)], names=["doc_id", out])

    pages = df.select(
        F.col(record).cast("bigint").alias("doc_id"),
        F.col(title).alias("title"),
        F.col(body).alias("body"),
        F.expr(f"greatest(coalesce(size(filter({links}, x -> x is not null)), 0), 0)").alias("links"),
        *([F.xxhash64(F.col(record).cast("bigint"), F.col(body)).alias("page")] if joined else []),
    )
    pages = spread(pages)
    if joined:
        pages = _looked_up(pages, table, rest).drop("page")
    return pages.mapInArrow(run, schema)


def furniture_lines(df: DataFrame, record: str, title: str, body: str, links: str) -> DataFrame:
    """(doc_id, line_no) of the non-blank lines outside the main body; lines count from 1. Pages without running text,
    heaps of keywords and null or blank bodies give no row. Forms are learned from all of `df`; where it is too small to
    show any, surge and dive decide alone."""
    return _pages(df, record, title, body, links, "line_no", "doc_id bigint, line_no int")


def main_text(df: DataFrame, record: str, title: str, body: str, links: str) -> DataFrame:
    """(doc_id, body) of the same pages: the kept lines, without blank ones."""
    return _pages(df, record, title, body, links, "body", "doc_id bigint, body string")
