"""Tokens of mixed Latin and Chinese text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.sources.workers import ship

# The patterns of tokens.
#: A Latin token: letters and digits, with points inside.
LATIN = r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*"
#: A run of Chinese characters.
HAN = "[一-鿿㐀-䶿]+"

# Words that are no search terms.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人",
    "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她",
    "它", "们", "那", "些", "么", "把", "被", "让", "给", "从",
    "向", "对", "为", "以", "与", "及", "等", "而", "或", "但",
    "如", "所", "之", "其", "如果", "因为", "所以", "但是",
    "虽然", "然而", "而且", "或者", "可以", "可能", "应该", "需要",
    "这个", "那个", "什么", "怎么", "如何", "哪个", "哪里", "多少",
    "这些", "那些", "一些", "每个", "任何", "所有", "其它", "其他",
    "啊", "呀", "吧", "呢", "吗", "哦", "嗯", "哈", "嘛",
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "can", "shall",
    "of", "in", "to", "for", "with", "on", "at", "from", "by",
    "and", "or", "not", "no", "it", "its", "this", "that",
    "as", "if", "but", "so", "than", "too", "very", "just",
]


def latin_tokens(text: Column) -> Column:
    """Lower-case Latin tokens without stop words, in order; null for null. Stays in the JVM."""
    found = F.regexp_extract_all(text, F.lit(LATIN), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(STOP_WORDS))


class Segmenter:
    """Cuts runs of Chinese characters along the likeliest path of dictionary words.

    `words` are (word, freq) pairs: of a repeated word the last frequency counts, all add to the total; a null
    frequency counts as 1. Characters at which no dictionary word starts stand alone.
    """

    def __init__(self, words: Iterable[tuple[str, int | None]], longest: int = 8, stop: Iterable[str] = STOP_WORDS):
        self.longest, self.stop = longest, frozenset(stop)
        self.weight: dict[str, int] = {}
        total = 0
        for word, freq in words:
            if word and len(word) <= longest:
                self.weight[word] = freq or 1
                total += freq or 1
        self.scale = math.log(total or 1)
        self.lexer = re.compile(f"({HAN})|({LATIN})")

    def cut(self, run: str) -> list[str]:
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            options = [(j, self.weight[run[i:j]]) for j in range(i + 1, min(n, i + self.longest) + 1) if run[i:j] in self.weight] or [(i + 1, 1)]
            # the first of equal options stays, so ties give the shortest word
            value, end = -math.inf, i + 1
            for j, freq in options:
                v = math.log(freq or 1) - self.scale + best[j][0]
                if v > value:
                    value, end = v, j
            best[i] = (value, end)
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def tokens(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        out: list[str] = []
        for han, latin in self.lexer.findall(text):
            out.extend(self.cut(han) if han else [latin.lower()])
        return [t for t in out if t.strip() and t not in self.stop]


def lexicon_words(df: DataFrame) -> list[tuple[str, int | None]]:
    """(word, freq) of a dictionary table, a repeated word once with its largest frequency; a dictionary is a bounded
    table that every worker holds anyway."""
    rows = df.where("word is not null and word <> ''").groupBy("word").agg(F.max("freq").alias("freq")).orderBy("word")
    return [(r.word, r.freq) for r in rows.collect()]


def segmented(df: DataFrame, text: str, out: str, words: list[tuple[str, int | None]], longest: int = 8) -> DataFrame:
    """`df` with the column `out` of tokens of mixed text: null for null, empty for empty."""
    holder: list[Segmenter] = []

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not holder:
            holder.append(Segmenter(words, longest))
        for x in batches:
            yield x.map(holder[0].tokens, na_action="ignore")

    ship(df.sparkSession)
    # called nondeterministic only so that a filter on `out` does not run the function a second time
    return df.withColumn(out, cut.asNondeterministic()(F.col(text)))


# Log probabilities of a run's first tag and of each tag after another, of begin, middle, end and single.
HMM_START = {"B": -0.2668, "S": -0.7165}
HMM_MOVE = {"B": {"M": -0.9322, "E": -0.5548}, "M": {"M": -0.8872, "E": -0.5764}, "E": {"B": -0.3748, "S": -1.2652}, "S": {"B": -0.5195, "S": -0.9206}}


def trained_emissions(words: Iterable[tuple[str, int | None]]) -> dict[str, dict[str, float]]:
    """Log probabilities of characters under each tag, from a dictionary's words weighted by their frequency (null: 1)."""
    sums: dict[str, dict[str, int]] = {t: {} for t in "BMES"}
    for word, freq in words:
        tags = "S" if len(word) == 1 else "B" + "M" * (len(word) - 2) + "E"
        for tag, c in zip(tags, word, strict=bool(word)):
            sums[tag][c] = sums[tag].get(c, 0) + (freq or 1)
    return {t: {c: math.log(n / sum(own.values())) for c, n in own.items()} for t, own in sums.items()}


def viterbi_cut(run: str, start: dict[str, float], move: dict[str, dict[str, float]], emit: dict[str, dict[str, float]], unseen: float = -math.log(65536)) -> list[str]:
    """Words of a run by the likeliest begin/middle/end/single tagging, all arguments log probabilities. An opt-in for
    text without a dictionary; `Segmenter` never needs it, for each of its words is in the dictionary or one character."""
    if not run:
        return []
    score = {s: start.get(s, -math.inf) + emit.get(s, {}).get(run[0], unseen) for s in "BMES"}
    back: list[dict[str, str]] = []
    for c in run[1:]:
        step = {s: max("BMES", key=lambda p, s=s: score[p] + move.get(p, {}).get(s, -math.inf)) for s in "BMES"}
        score = {s: score[p] + move.get(p, {}).get(s, -math.inf) + emit.get(s, {}).get(c, unseen) for s, p in step.items()}
        back.append(step)
    tag = max("ES", key=score.__getitem__)
    tags = [tag]
    for step in reversed(back):
        tag = step[tag]
        tags.append(tag)
    words, begin = [], 0
    for i, t in enumerate(reversed(tags)):
        if t in "ES":
            words.append(run[begin : i + 1])
            begin = i + 1
    return words + ([run[begin:]] if begin < len(run) else [])
