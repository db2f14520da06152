"""Text that was decoded with the wrong character encoding, and its repair.

A best-first search over states of a text: an edge encodes the text with one encoding and decodes the bytes with
another, or unescapes character references. States are known by hash and visited once; the queue is ordered by a cost
of how implausible the characters are side by side, plus a small price per edge. The search ends at a plain text, or
when no state is left that isn't dearer than the start by far; it counts no states. The cheapest state reached is the
answer if it is clearly cheaper than the start. What stays implausible, or holds replacement characters, is affected
but lost.

A line is searched if what `cost` charges it beyond ordinary characters, also after resolving character references,
could be lowered by enough. All encodings read ASCII alike, so only ASCII lines without references need no cost at all.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lakesearch.sources.workers import ship, spread

# Encodings of web pages of the Western, Russian and Chinese languages.
ENCODINGS = ["cp1252", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "gb18030"]
DECODINGS = ["gb18030", "cp1252", "cp1251", "koi8_r", "mac_roman", "cp866"]
#: Longest path and price of an edge. A state that costs more than SLACK times the start and 4 isn't gone on from.
DEPTH, EDGE, SLACK = 4, 0.25, 3.0
#: A repair must leave at most this part of the start's cost, and save at least so much.
KEEP, GAIN = 0.5, 0.75
#: Cost per character beyond which unrepaired text counts as lost.
LOST = 0.75

_WEST_LOWER = "àâäáãåçéèêëíìîïñóòôöõúùûüßœæøÿý"
_WEST_UPPER = "ÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜŒÆØÝ"
_SIGNS = "«»©®°¿¡·§№€"
_QUOTES = "“”‘’„–—…•‹›"
_ARROWS = "←→↑↓"
_BOX = "─│┌┐└┘├┤┬┴┼═║"
_CJK_MARKS = "、。〈〉《》「」『』【】〔〕！（），．：；？～＃％＆＊－／［］"


class _Classes(dict):
    """Code point -> one letter for its kind, filled as met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if point < 128:
            k = "a" if c.islower() else "A" if c.isupper() else "d" if c.isdigit() else "s" if c in " \t\r\n" else "p" if point >= 32 else "x"
        elif c in _WEST_LOWER:
            k = "e"
        elif c in _WEST_UPPER:
            k = "E"
        elif c in _QUOTES:
            k = "t"
        elif c in _SIGNS:
            k = "g"
        elif c == " " or c == "　":
            k = "n"
        elif "а" <= c <= "я" or c == "ё":
            k = "c"
        elif "А" <= c <= "Я" or c == "Ё":
            k = "C"
        elif c in _BOX:
            k = "b"
        elif c in _ARROWS:
            k = "r"
        elif "０" <= c <= "ｚ" or c in _CJK_MARKS:
            k = "f"
        elif "一" <= c <= "鿿":
            try:
                k = "z" if 0xB0 <= c.encode("gb2312")[0] <= 0xD7 else "Z"
            except UnicodeEncodeError:
                k = "Z"
        elif point < 0xA0 or c == "�" or 0xE000 <= point <= 0xF8FF or point > 0x2FFFF:
            k = "x"
        elif point < 0x100:
            k = "y"
        elif 0x400 <= point < 0x530:
            k = "k"
        elif 0x2500 <= point < 0x25A0:
            k = "B"
        else:
            k = "o"
        self[point] = k
        return k


_CLASS = _Classes()
_ONE = {"x": 4.0, "Z": 1.2, "k": 1.2, "y": 1.0, "o": 1.2, "B": 2.0, "e": 0.03, "E": 0.12, "g": 0.05, "t": 0.02, "C": 0.02, "b": 0.15, "n": 0.06}
_TWO = {
    "aE": 3.0, "eE": 2.5, "cE": 3.0, "Ee": 1.2, "EE": 0.5, "ee": 0.5, "ey": 1.5, "Ey": 1.5, "ay": 1.5, "Ay": 1.0, "ya": 1.0, "ye": 1.0, "yE": 1.0, "yy": 1.0,
    "Eg": 3.0, "eg": 1.5, "ag": 1.0, "Ag": 0.6, "En": 2.5, "Et": 2.0, "et": 0.3, "tE": 0.4, "eA": 1.0, "ty": 1.0, "tg": 0.8, "yt": 1.0, "gy": 0.8, "gE": 0.8, "Eo": 1.5, "eo": 1.5, "oy": 1.0, "oo": 0.5,
    "cC": 2.5, "Ct": 1.2, "Cg": 1.5, "Cy": 2.0, "Ck": 1.5, "ck": 1.0, "kc": 1.0, "cy": 1.5, "Cn": 0.8, "CC": 0.35,
    "ac": 2.0, "ca": 2.0, "aC": 2.0, "Ca": 1.2, "Ac": 2.0, "cA": 2.0, "AC": 1.5, "CA": 1.5, "ec": 2.0, "ce": 2.0, "eC": 2.0, "Ce": 2.0, "Ec": 2.0, "CE": 2.0, "EC": 2.0,
    "ab": 1.5, "ba": 1.0, "be": 1.5, "eb": 1.5, "by": 1.5, "yb": 1.5, "bg": 1.5, "bE": 1.5, "Eb": 1.5, "Ab": 1.0, "bc": 1.5, "cb": 1.5, "bC": 1.5, "Cb": 1.5, "zb": 1.0,
    "zk": 1.5, "kz": 1.5, "ze": 1.0, "ez": 1.0, "zE": 1.0, "zc": 1.0, "cz": 1.0, "zC": 1.0, "ea": 0.0, "ao": 0.8, "oa": 0.8, "af": 1.0, "fa": 1.0, "zy": 0.8, "yz": 0.8, "za": 1.2, "az": 0.6, "sz": 0.3, "zs": 0.3,
}
#: Classes whose charge only makes one reading preferred to another.
_ORDINARY = "eEgtCbn"
#: Two accented letters of one case, no more, as in "größe" and "AÇÃO": their charge is as ordinary.
_COUPLE = re.compile("(?<![eE])(?:ee|EE)(?![eE])")
# Per mille of the letters in Russian text.
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.5, 2], strict=True))


#: A guillemet that opens before a capital or closes a word: its charge is ordinary.
_OPENING, _CLOSING = re.compile(r"(?<!\w)«(?=[À-Ý])"), re.compile(r"(?<=[ß-öø-ÿ])»(?!\w)")
#: A lone Russian letter between Latin words, a lone accented one that is no word, or before a capital.
_LONE = re.compile(r"[^\W\d_a-zA-ZàÀ一-鿿](?:(?<=[A-Za-z] .)(?:(?<=[^éèòóáÉ])(?= [A-Za-z])|(?<=[éèòóá])(?= [A-Z]))|(?<=^[а-яё])(?= \d))")
#: Quotation marks or brackets inside a word, dashes between small letters, a no-break space where a line begins.
_INSIDE_WORD = re.compile(
    r"[“”„•‹›…–—‘’\xa0\^\[\]{}\\](?:"
    r"(?:(?<=[^\W\d_][“”„•‹›…])|(?<=[^\W\d_][–—])(?=[–—“”„•‹›…]*[“”„•‹›…]))[“”„•‹›–—…]*(?=[^\W\d_])"
    r"|(?<=[a-zß-ÿ][‘–—])(?=[a-zß-ÿ])|(?<=[a-zß-ÿ]{2}[‘’])(?=[À-Ý])|(?<=[a-zß-ÿ][–—“”„][“”„])(?=\W|$)"
    r"|(?<=^\xa0)(?=\w)|(?<=[^\W\d_][\^\[\]{}\\])[\^\[\]{}\\]*(?=[^\W\d_]))"
)
#: What hardly any Russian word has: ь, ъ or ы after a vowel or at the beginning, three vowels or five consonants in a row,
#: no vowel at all.
_NOT_RUSSIAN = re.compile(
    r"[ьъы](?:(?<![а-яё].)|(?<=[аеёиоуыэюяйьъ].))|[аеёиоуыэюя]{3}|[бвгджзклмнпрстфхцчшщь]{5}|[ьъ][ьъыаоэ]|[бвгджзклмнпрстфхцчшщ](?<![а-яё].)[бвгджзклмнпрстфхцчшщ]{2,}(?![а-яё])"
)


def _russian_costs() -> dict[str, float]:
    from math import log

    return {c: 0.55 * (-log(n / 1000) - 3.15) for c, n in _RUSSIAN.items()}


_LETTER = _russian_costs()

#: Characters that are plausible by themselves.
_plain = f"{_WEST_LOWER}{_WEST_UPPER}{_QUOTES}{_SIGNS}{_ARROWS}{_BOX}{_CJK_MARKS}"


def _level_one() -> str:
    """The common Chinese characters: the first level of GB 2312."""
    return "".join(bytes((a, b)).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF))


@lru_cache(1)
def _suspect() -> re.Pattern:
    """What only wrong decoding leaves, though nothing may repair it."""
    ordinary = f"\\x20-\\x7e\\t\\r\\n 　а-яА-ЯёЁ０-ｚ{re.escape(_plain)}{_level_one()}"
    up, low = _WEST_UPPER, _WEST_LOWER
    signs, quotes, latin = re.escape(_SIGNS), re.escape(_QUOTES), f"a-zA-Z{low}{up}"
    # one character beyond ASCII, then what may be wrong about it and its neighbours
    return re.compile(
        f"[^\\x00-\\x7f](?:(?<=[^{ordinary}])"
        f"|(?<=[{up}])(?:(?<=[a-z{low}а-я].)|(?=[{low}{signs}{quotes}\\u00a0]))"
        f"|(?<=[{low}])(?=[{low}]{{2}})|(?<=[{up}{low}])(?=[{up}{low}]{{3}})"
        f"|(?<=[{latin}][{signs}])(?=[{latin}])"
        f"|(?<=[а-яёА-ЯЁ])(?:(?<=[{latin}].)|(?=[a-z{low}{up}])|(?<=[А-ЯЁ])(?:(?<=[а-яё].)|(?=[{quotes}©®°·§№€\\u00a0])|(?=[А-ЯЁ]{{2}})))"
        f"|(?<=[{_BOX}])(?:(?<=[{latin}а-яА-Я].)|(?=[{latin}а-яА-Я{signs}])))",
        re.DOTALL,
    )


#: Where a Latin word runs into a Russian one, as in tags; wrong decoding mixes single letters.
_GLUED = re.compile(r"(?<=[A-Za-z]{3})(?=[а-яА-Я][а-я]{3})|(?<=[а-я]{3})(?=[A-Za-z]{3})")

_RUSSIAN_LETTER = re.compile("[а-яА-Я]")
#: ASCII but control characters, three characters away from any other.
_INSIDE = re.compile(r"(?<=[\x00-\x7f]{3})[\t\n\r\x20-\x7e]+(?=[\x00-\x7f]{3})")


@lru_cache(1)
def _charged() -> re.Pattern:
    """Whatever `evidence` counts, as kinds, beside Russian letters: a class beyond the ordinary ones, a pair that costs."""
    pairs: dict[str, str] = {}
    for (a, b), w in ((p, w) for p, w in _TWO.items() if w):
        pairs[a] = pairs.get(a, "") + b
    return re.compile(f"[{''.join(k for k in _ONE if k not in _ORDINARY)}]|" + "|".join(f"{a}[{b}]" for a, b in pairs.items()))


def _costs(text: str) -> tuple[float, float]:
    """(cost, evidence) of a text."""
    russian = bool(_RUSSIAN_LETTER.search(text))
    # nothing is charged inside a stretch of ASCII, so only its ends are looked at
    text = _INSIDE.sub("0", _GLUED.sub(" ", text) if russian else text)
    kinds = text.translate(_CLASS)
    small = sum(_ONE[k] * n for k in _ORDINARY if (n := kinds.count(k)))
    charged = _charged().search(kinds) or _INSIDE_WORD.search(text) or _LONE.search(text)
    strange = total = rare = 0.0
    if russian:
        low = text.lower()
        letters = [(c, n) for c in _LETTER if (n := low.count(c))]
        n_letters = sum(n for _, n in letters)
        strange = sum(_LETTER[c] * n for c, n in letters) - 0.12 * n_letters
        rare = max(0.0, strange) if n_letters > 5 else 0.0
        total = rare + 0.8 * len(_NOT_RUSSIAN.findall(low))
    if not charged:
        return total + small, total if total - rare > 0.01 else 0.0
    total += sum(1.2 * len(x) for x in _INSIDE_WORD.findall(text)) + 0.9 * len(_LONE.findall(text))
    counts = Counter(kinds)
    for k, n in counts.items():
        if k in _ONE and k not in _ORDINARY:
            total += _ONE[k] * n
    for (a, b), n in Counter(zip(kinds, kinds[1:], strict=False)).items():
        if (w := _TWO.get(a + b)) is not None:
            # capitals are as good as small letters where they make Russian words
            total += w * n * (0.1 if a + b == "CC" and strange <= 0 else 1)
    total -= 0.5 * len(_COUPLE.findall(kinds)) + _TWO["gE"] * len(_OPENING.findall(text)) + _TWO["eg"] * len(_CLOSING.findall(text))
    # rare letters of a short Russian text show nothing by themselves
    return max(0.0, total) + small, total if total - rare > 0.01 else 0.0


def cost(text: str) -> float:
    """Implausibility of the characters of a text, about 0 for clean text of the known languages."""
    return _costs(text)[0]


def evidence(text: str) -> float:
    """The cost without the small charges of ordinary characters: a long line of accented words collects those, and
    is clean."""
    return _costs(text)[1]


def _sloppy(name: str) -> dict[int, int]:
    """Character -> byte of a one-byte encoding, undefined bytes standing for the control characters of their number."""
    table = {}
    for b in range(256):
        try:
            c = bytes((b,)).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table[ord(c)] = b
        if name == "cp1252":
            table.setdefault(b, b)
    return table


@lru_cache(1)
def _tables() -> dict[str, dict[int, int]]:
    return {n: _sloppy(n) for n in ENCODINGS if n != "gb18030"}


def _bytes(text: str, name: str) -> bytes | None:
    if name == "gb18030":
        try:
            raw = text.encode("gbk")  # four-byte codes come from no real page
        except UnicodeEncodeError:
            return None
        return raw
    try:
        return bytes(map(_tables()[name].__getitem__, map(ord, text)))
    except KeyError:
        return None


_REFERENCE = re.compile(r"&#?\w{2,8};")


def _edges(text: str) -> Iterator[str]:
    raws = [(n, raw) for n in ENCODINGS if (raw := _bytes(text, n)) is not None]
    unicode = False
    for _, raw in raws:
        try:
            yield raw.decode("utf-8")
            unicode = True  # bytes that happen to be UTF-8 are UTF-8: no other reading is tried
        except UnicodeDecodeError:
            pass
    for wrong, raw in () if unicode else raws:
        for right in DECODINGS:
            if right != wrong:
                try:
                    yield raw.decode("gbk" if right == "gb18030" else right)
                except UnicodeDecodeError:
                    pass
    if _REFERENCE.search(text):
        yield html.unescape(text)


def search(text: str, start: float) -> tuple[str, float]:
    """The cheapest text reachable from `text`, whose cost is `start`, and its cost with the price of the path."""
    best, best_cost = text, start
    seen = {hash(text)}
    queue: list[tuple[float, int, int, str]] = [(start, 0, 0, text)]
    number = 0
    while queue:
        at, depth, _, state = heapq.heappop(queue)
        for other in _edges(state):
            if (key := hash(other)) in seen:
                continue
            seen.add(key)
            c = cost(other) + EDGE * (depth + 1)
            if c < best_cost:
                best, best_cost = other, c
            if depth + 1 < DEPTH and c <= SLACK * start + 4:
                number += 1
                heapq.heappush(queue, (c, depth + 1, number, other))
        # nothing implausible is left, or whatever comes costs its path alone more than the best
        if best_cost <= EDGE * (depth + 1) + 0.012 * len(best) or queue and best_cost <= EDGE * (min(q[1] for q in queue) + 1):
            break
    return best, best_cost


def _ascii(text: str) -> bool:
    """Whether no edge changes the text."""
    return text.isascii() and "&" not in text


def _start(line: str) -> tuple[str, float, float]:
    """Where the search begins, its cost and evidence: the line, or what its character references hide if that costs
    more."""
    at, shown = (0.0, 0.0) if line.isascii() else _costs(line)
    if "&" in line and _REFERENCE.search(line):
        other = html.unescape(line)
        if not other.isascii() and (c := _costs(other))[1] > shown:
            return other, *c
    return line, at, shown


def _repaired(line: str) -> str | None:
    """The line after one search, null if nothing clearly cheaper was reached."""
    begin, start, shown = _start(line)
    if shown < GAIN:
        return None
    best, c = search(begin, start)
    if _RUSSIAN_LETTER.search(best) and not _suspect().search(begin):
        return None  # Chinese words between spaces, no Russian: its wrong readings hold rarer characters
    # what is saved is counted without the price of the path
    return best if c <= KEEP * start and shown - evidence(best) >= GAIN else None


#: Lines up to this length are kept once judged, for sites repeat their short lines; it bounds what a process remembers.
KEPT = 200


def repair(line: str) -> tuple[str, bool]:
    """A line as it should read, and whether it was wrongly decoded (also if it can't be restored)."""
    return _known(line) if len(line) <= KEPT else _judged(line)


@lru_cache(maxsize=40_000)
def _known(line: str) -> tuple[str, bool]:
    return _judged(line)


def _judged(line: str) -> tuple[str, bool]:
    if _ascii(line) or _start(line)[2] < GAIN:
        return line, False
    if (best := _repaired(line)) is not None:
        # what one search leaves may be plain for the next; every turn lowers the cost by half at least
        return repair(best)[0], True
    # parts of a line may be wrong on their own
    words = line.split(" ")
    fixed, hit = [], "�" in line
    for i, word in enumerate(words):
        if not _ascii(word):
            # the space behind a word is part of its evidence
            space = " " if i + 1 < len(words) else ""
            if (new := _repaired(word + space)) is not None:
                word, hit = new.removesuffix(space), True
        fixed.append(word)
    if hit:
        mended = " ".join(fixed)
        return (repair(mended)[0] if mended != line else line), True
    # Latin beside Chinese is a sign only where a repair is found: by itself it doesn't make a line lost
    odd = sum(not c.isascii() for c in line)
    return line, odd >= 3 and cost(line) > LOST * odd + 1 and bool(_suspect().search(line))


def repair_text(text: str | None) -> tuple[str | None, bool]:
    """Every line of a text repaired; whether any was wrong. Null stays null."""
    if not text or _ascii(text):
        return text, False
    done = [repair(x) for x in text.split("\n")]
    if not any(hit for _, hit in done):
        return text, False
    return "\n".join(x for x, _ in done), True


SCHEMA = "doc_id bigint, field_name string, restored string, recovered boolean"


def restore(df: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """One row (doc_id, field_name, restored, recovered) per field of a record with wrongly decoded text.

    `recovered` is false where implausible or replacement characters remain. No shuffle; whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for i, field in enumerate(fields, 1):
                for doc, text in zip(docs, batch.column(i).to_pylist(), strict=True):
                    new, hit = repair_text(text)
                    if hit:
                        clean = "�" not in new and not any(repair(x)[1] for x in new.split("\n"))
                        for column, v in zip(out, (doc, field, new, clean), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "field_name", "restored", "recovered"])

    ship(df.sparkSession)
    return spread(df.select(df[record].cast("long").alias("doc_id"), *fields)).mapInArrow(run, SCHEMA)
