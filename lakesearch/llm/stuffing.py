"""Pages that are heaps of repeated keywords, links or product tags rather than sentences.

The suffix automaton of every page's token sequence tells, for each place, the longest run of tokens ending there that
stands elsewhere in the page too: the length of the state's suffix link. The union of these runs are the characters
covered by repeated maximal substrings. They are weighed against the characters that stand in clauses, sentences of some
length that aren't made of such repeats themselves; what is neither, a missing structure, speaks for a heap by a part of
its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.mojibake import repair_text
from lakesearch.sources.workers import ship, spread

#: A repeat counts from this many tokens; a Chinese character is half a token.
LEAST_RUN, LEAST_CLAUSE_RUN = 2.0, 3.0
#: Weight of a character in a clause against one in a repeat, and of one in neither: LOOSE, or LOOSE_LINKED where a link
#: comes on at most LINK_CHARS characters.
CLAUSE, LOOSE, LOOSE_LINKED, LINK_CHARS = 2.0, 0.25, 0.5, 40
#: Characters in clauses that any page has the credit of: a few repeated words are no evidence yet.
CREDIT = 42
#: Sentences made of repeats are no clauses on a page of so poor a vocabulary (different words to words); elsewhere they
#: are just said twice.
POOR = 0.3
#: A sentence is a clause from this many words, of which this part differ, and at most this part in repeats.
WORDS, DISTINCT, DISTINCT_HAN, REPEATED = 6, 0.6, 0.45, 0.6

_TOKEN = re.compile(r"\n|[一-鿿]|[^\W\d_一-鿿]+|\d+|[^\w\s]|_")
_INNER = re.compile(r"[.!?](?=\w)")
_STOPS = frozenset(".!?。！？\n")
_SPACE = re.compile(r"\s*\n\s*")


def repeat_lengths(tokens: list[str]) -> list[int]:
    """For each place, how many tokens ending there stand, in this order, elsewhere too."""
    step: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last, ends = 0, []
    for token in tokens:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        ends.append(new)
        state = last
        last = new
        while state >= 0 and token not in (out := step[state]):
            out[token] = new
            state = link[state]
        if state < 0:
            link.append(0)
            continue
        target, least = step[state][token], length[state] + 1
        if length[target] == least:
            link.append(target)
            continue
        # the target stands for longer strings too: part the shorter ones off
        twin = new + 1
        step.append(step[target].copy())
        length.append(least)
        link.append(twin)
        link.append(link[target])
        link[target] = twin
        while state >= 0 and (out := step[state]).get(token) == target:
            out[token] = twin
            state = link[state]
    # a whole beginning that comes again is the longest string of its own state, and then some state links to it
    inner = set(link)
    return [length[s] if s in inner else length[link[s]] for s in ends]


def _tokens(text: str) -> list[str]:
    """Words, numbers, Chinese characters, marks and line ends; a point inside a word and :// become marks of their own."""
    text = _SPACE.sub("\n", text.lower().strip()).replace("://", "\x01")
    return _TOKEN.findall(_INNER.sub("\x02", text))


def _clauses(tokens: list[str], sizes: list[int], repeated: list[bool] | None, enough: float = float("inf")) -> int:
    """Characters in sentences of some length and variety that aren't made of repeats; counted until they are `enough`."""
    total, begin = 0, 0
    for i in [i for i, t in enumerate(tokens) if t in _STOPS]:
        if i - begin >= WORDS and tokens[i] != "\n":
            part = tokens[begin : i + 1]
            words = [w for w in part if w.isalpha()]
            if len(words) >= WORDS and "\x01" not in part:
                han = 0 if "".join(words).isascii() else sum("一" <= w <= "鿿" for w in words)
                if len(words) - han / 2 >= WORDS and len(set(words)) >= (DISTINCT if han * 2 < len(words) else DISTINCT_HAN) * len(words):
                    size = sum(sizes[begin : i + 1])
                    if repeated is None or sum(compress(sizes[begin : i + 1], repeated[begin : i + 1])) <= REPEATED * size:
                        total += size
                        if total >= enough:
                            break
        begin = i + 1
    return total


def measure(tokens: list[str], sizes: list[int], poor: bool = True) -> tuple[float, float]:
    """(part in repeats, part in clauses) of a page's characters, by its suffix automaton."""
    runs = repeat_lengths(tokens)
    mass = list(accumulate((0.5 if "一" <= t <= "鿿" else 1.0 for t in tokens), initial=0.0))
    n, total = len(tokens), sum(sizes)
    covered, first, first_long = 0, n, n
    long_runs = [False] * n
    for i in range(n - 1, -1, -1):
        start = i - runs[i] + 1
        m = mass[i + 1] - mass[start]
        if m >= LEAST_RUN:
            first = min(first, start)
            if m >= LEAST_CLAUSE_RUN:
                first_long = min(first_long, start)
        if i >= first:
            covered += sizes[i]
        long_runs[i] = i >= first_long
    return covered / total, _clauses(tokens, sizes, long_runs if poor else None) / total


def _weigh(title: str | None, text: str, links: int, sure: bool) -> float:
    if text.count("�") * 20 > len(text):
        return 0.0  # of lost text neither repeats nor clauses can be told
    tokens = _tokens(f"{title}\n{text}" if title else text)
    sizes = list(map(len, tokens))
    for i in [i for i, t in enumerate(tokens) if t == "\n"]:
        sizes[i] = 0
    size = sum(sizes)
    if not size:
        return 0.0
    words = [t for t in tokens if t.isalpha()]
    poor = len(set(words)) < POOR * len(words)
    if sure and not poor and CLAUSE * _clauses(tokens, sizes, None, size / CLAUSE) >= size:
        return 0.0  # even if every character were in a repeat, the clauses would outweigh them
    repeats, clauses = measure(tokens, sizes, poor)
    loose = LOOSE_LINKED if links and size <= LINK_CHARS * links else LOOSE
    return (repeats + loose * max(0.0, 1 - repeats - clauses) - CLAUSE * clauses) * size - CLAUSE * CREDIT


def weight(title: str | None, body: str | None, links: int, sure: bool = False) -> float:
    """Evidence that a page is a heap, less evidence that it isn't, in characters. Null and empty bodies have none.

    Wrongly decoded sentences may look like a heap, so a heap must be one both as it stands and as it should read: the
    lesser weight counts. With `sure` a page that clauses alone clear is 0 without its automaton.
    """
    if not body or (found := _weigh(title, body, links, sure)) <= 0:
        return 0.0
    text, wrong = repair_text(body)
    return min(found, _weigh(title, text, links, sure)) if wrong else found


def is_heap(title: str | None, body: str | None, links: int) -> bool:
    """Whether a page is a heap of keywords, links or tags."""
    return weight(title, body, links, sure=True) > 0


def heaps(df: DataFrame, record: str, title: str, body: str, outlinks: str) -> DataFrame:
    """(record) of the heaps. A null outlinks array counts as no links. No shuffle; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, bodies, links = (batch.column(i).to_pylist() for i in (1, 2, 3))
            keep = [weight(t, b, n) > 0 for t, b, n in zip(titles, bodies, links, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=[record])

    ship(df.sparkSession)
    links = F.coalesce(F.size(F.filter(outlinks, lambda x: x.isNotNull())), F.lit(0))
    kind = df.schema[record].dataType.simpleString()
    return spread(df.select(record, title, body, F.greatest(links, F.lit(0)).alias("links"))).mapInArrow(run, f"{record} {kind}")
