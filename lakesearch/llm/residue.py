"""Template residue, filler, error messages and script or access notices standing in for content.

Normalised lines of all pages are counted by host, as hashes. What recurs over a host is its boilerplate and is subtracted
from its pages; a page with evidence in what is left, or in its title, is a residue. A page that holds nothing but
recurrent lines has no other content, so it is judged whole: a host that answers with one error page everywhere is not
let off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.sitelines import normal_line
from lakesearch.sources.shared import materialize
from lakesearch.sources.workers import ship, spread

#: A line in at least so many pages, and at least this percentage, of its host is boilerplate.
BOILER_PAGES, BOILER_PERCENT = 4, 30

# Marks that templates leave where a value was to be filled in. A mark right behind a quotation mark is a
# mention of it, not a residue.
MARKS = r"""(?<![“"«‘'`„])(?:\{\{[^{}\n]*\}\}|\{%[^%\n]+%\}|<\?(?:php|=)|<%[^%\n]+%>|\$\{+[^{}\n]+\}|#\{[\w.]+\}"""
MARKS += r"""|@@\w+@@|%%\w+%%|(?<![\w%])%[A-Z][A-Z_]{3,}%|_{2,3}[A-Z][A-Z_]+?_{2,3}|\[\[[\w. ]+\]\]|\[object \w+\]"""
MARKS += r"""|\[/?shortcode[^\]\n]*\]|<!-- ?/?ko\b|&lt;[a-z_]+&gt;|<(?:name|first_?name|city|title|date|company|place|price|summary|headline)>|&#123;&#123;|(?i:\[insert [^\]\n]+\])|\bInvalid Date\b|\{\d+\}|%\(\w+\)[a-z]\b|(?<!\S)%[sd](?!\S)|\[[^\Wa-zà-öø-ÿа-яё\d_]+(?:[ _][^\Wa-zà-öø-ÿа-яё\d_]+)+\])"""

# Words of filler text, in the spellings that generators vary.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor tempora incididunt labore dolore magna aliqua aliqu enim minim veniam quis quisto nostrud "
    "ullamco laboris nisi aliquip commodo consequat duis aute irure velit esse cillum fugiat nulla pariatur semir vestra vexit gravo gravida mattis ornat ornare pellat "
    "pellentesque suspen suspendisse porto porta rutil rutrum sodo sodales tellun tellus finum finibus hendra hendrerit loqui marun demat colora vestibulum maecenas"
).split()
FILLER = r"(?i)(?:\b(?:" + "|".join(FILLER_WORDS) + r")\b[\s.,;]*){6}"

# Whole lines or sentences that are messages. Languages: English, French, German, Spanish, Portuguese, Russian, Chinese.
LINES = [
    # placeholders and filler
    r"(?:your|my|the) (?:content|text|copy|title|headline) (?:goes )?here\b.*", r"(?:sample|dummy|placeholder|example) (?:text|content|copy)\b.*(?:here|edit|replace).*", r"replace this (?:text|copy|paragraph)\b.*",
    r"(?:description|text) of (?:product|item|service)s? ?\d* goes (?:in|into) this (?:box|field|space)\b.*", r"(?:todo|tbd|fixme|tk)\b ?[:\-–].*", r"(?:asdf|qwerty|test|foo|bar|blah|xxx)(?:[ ,.]+(?:asdf|qwerty|test|foo|bar|blah|xxx|\d+))+\.?",
    r"(?:sub)?heading(?: \d+)?", r"x{3,}(?: x{3,})+\.?", r"(?:image|photo|figure) (?:caption|placeholder|goes here)\.?", r"(?:exemple de texte|texte d['’]exemple|beispieltext|mustertext|platzhaltertext|текст для примера|пример текста|示例文字|示例文本|占位(?:文字|文本))\b.*", r"button(?: text| label)?", r"(?:add|insert|enter|type) (?:your|some) (?:text|content|title)\b.*", r"click (?:here )?to (?:edit|add)\b.*",
    r"ceci est un texte de remplissage\b.*", r"(?:votre|saisissez votre|insérez votre) (?:texte|contenu) (?:ici)\b.*", r"(?:hier steht ihr text|dies ist ein blindtext|blindtext)\b.*", r"(?:(?:este es un )?texto de (?:relleno|ejemplo|prueba)|(?:escriba|inserte|aquí va) (?:aquí )?su texto)\b.*",
    r"(?:(?:este é um )?texto de (?:exemplo|preenchimento|teste)|(?:escreva|insira) (?:aqui )?o? ?seu texto|o seu texto aqui)\b.*", r"здесь будет (?:ваш )?текст.*", r"(?:текст-заполнитель|введите (?:ваш )?текст).*", r"(?:此处|这里|请在此)(?:填写|输入|插入|放置).*(?:内容|文字|文本|正文).*",
    # values that scripts failed to fill in
    r"(?:undefined|null|nan|none|\[object object\])(?:[ ,/|·\-]+(?:undefined|null|nan|none|\[object object\]))+", r"(?:price|date|author|title|name|total|by|posted by|published)\b ?:? ?(?:undefined|null|nan|none|invalid date)\b.*", r"undefined|\[object object\]",
    # pages that are missing
    r"(?:error |http |fehler |erreur |erro |ошибка |错误 ?)?(?:400|401|403|404|410|429|500|502|503|504)[.: \-–—]*(?:(?:page |file )?not found|forbidden|gone|unauthorized|bad (?:gateway|request)|internal server error|service unavailable|gateway time-?out|too many requests|error|(?:запрошенная )?страница.*|seite nicht gefunden|page introuvable|página no encontrada|页面.*)?\.?",
    r"(?:page )?not found\.?", r"(?:oops|whoops|uh-oh)\b[!,. ].*", r"(?:sorry, )?(?:there is |there's )?nothing (?:was )?(?:found )?here\.?(?: .*)?", r"no results(?: found)?\.?(?: try another search\.?)?", r"sorry, (?:we can['’]t|we cannot|we could not|we couldn['’]t) find (?:that|this|the) page\.?",
    r"the (?:article|page|document|file|content|address|link) (?:you are looking for|you requested|requested)\b.*(?:has been|was|is|does|could|no longer).*", r"the requested (?:address|url|page|resource|file)\b.*", r"this (?:page|article|content) (?:is gone|no longer exists|does not exist|has been removed|has moved|is not available|could not be found)\b.*",
    r"it may have (?:moved|been removed|been deleted)\b.*", r"this content is not available\b.*", r"(?:die )?angeforderte seite (?:existiert nicht|wurde nicht|konnte nicht)\b.*", r"(?:die )?seite (?:wurde )?nicht gefunden\.?", r"fehler \d{3}\.?", r"la page (?:demandée|que vous cherchez)\b.*(?:est|n['’]).*", r"page (?:introuvable|non trouvée)\.?",
    r"(?:lo sentimos, )?la (?:dirección|página) (?:solicitada|que busca)\b.*", r"página no encontrada\.?", r"(?:lamentamos, |desculpe, )?(?:a|o) (?:página|endereço) (?:solicitad[ao]|pedid[ao]|que procura|procurad[ao])\b.*", r"página não encontrada\.?", r"(?:ошибка \d{3}\. ?)?(?:запрошенная |запрашиваемая )?страница (?:не найдена|не существует|удалена)\.?.*",
    r"(?:抱歉[，,])?您?(?:所)?(?:访问|请求|查找|寻找)的(?:页面|网页|内容|地址).*", r"(?:页面|网页)(?:不存在|未找到|找不到|已被删除).*",
    # servers that failed
    r"(?:500 |502 |503 |504 )?(?:internal server error|bad gateway|service unavailable|gateway time-?out)\.?", r"the server (?:is temporarily|encountered|was unable|is unable|could not)\b.*", r"(?:down for|under|we are in) (?:scheduled )?maintenance\b.*", r"upstream (?:timed out|prematurely closed|sent)\b.*", r"(?:fatal|parse|syntax|uncaught|runtime|database) error\b ?[:!].*",
    r"(?:warning|notice|deprecated): .*(?:failed|undefined|query|deprecated|table|cannot|unable|division|include).*", r"traceback \(most recent call last\):?", r"stack trace:?", r"#\d+ \{main\}", r"#\d+ /\S+\(\d+\):.*", r"file \"?/\S+\.(?:py|php|rb|js)\"?, line \d+.*", r"(?:key|value|type|name|index|attribute|import|runtime|syntax|reference|io|os)error\b ?:.*", r"(?:uncaught |unhandled )?exception\b.*(?:in|:).*",
    r"(?:an? )?(?:unexpected |unknown )?error (?:has )?occurred\b.*", r"something went wrong\b.*", r"error establishing a database connection\.?",
    # scripts, checks and rights
    r"(?:please )?(?:enable|turn on|activate|allow) (?:java)?scripts?\b.*", r"(?:java)?scripts? (?:is|are|must be|has been) (?:disabled|required|turned off|not enabled|blocked|enabled)\b.*", r"(?:this|our) (?:site|page|website|application|app) (?:needs|requires|works best with) (?:java)?scripts?\b.*", r"you (?:need|have) to (?:allow|enable|activate|turn on) (?:java)?scripts?\b.*", r"noscript", r"your browser (?:is not supported|is out of date|does not support|is outdated)\b.*",
    r"(?:veuillez )?activer (?:le )?javascript\b.*", r"(?:bitte )?aktivieren sie (?:bitte )?javascript\b.*", r"(?:por favor,? )?(?:active|activa|habilite|habilita|ative) (?:el |o )?javascript\b.*", r"(?:для .*)?(?:включите|разрешите) javascript.*", r"请?(?:先)?(?:启用|开启|允许) ?javascript.*",
    r"checking your browser\b.*", r"this takes a few seconds\.?", r"unusual traffic\b.*", r"(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?(?:human|not a robot)\b.*", r"are you (?:a robot|human)\??", r"(?:please )?(?:solve|complete) the (?:puzzle|captcha)\b.*", r"(?:access|permission) denied\b.*", r"forbidden\.?", r"you (?:do not|don['’]t) have (?:the )?(?:permission|access|rights?)\b.*", r"you are not (?:allowed|authorized)\b.*", r"(?:your )?session (?:has )?(?:expired|timed out)\b.*", r"(?:please )?(?:log|sign) in to (?:view|see|read|continue)\b.*",
    r"just a moment(?:…|\.{3})?", r"loading ?(?:…|\.{3})", r"please wait ?(?:…|\.{3})?", r"attention required!?",
]
# Titles that are residues though the same words may be a line of an article page.
TITLES = [r"error(?: \d{3}(?: ?[-–] .*)?)?", r"untitled(?: (?:document|page|\d+))?", r"sample page", r"(?:home|page|new page|index|document) ?\d+", r"new page\b.*", r".*title goes here", r"(?:page|post) title", r"(?:неизвестная )?ошибка(?: \d{3})?", r"hello world!?"]

_REF = r"(?: \(ref\.? ?\d+\))?"
_LINE = re.compile("(?:" + "|".join(LINES) + ")" + _REF + "$", re.IGNORECASE)
_TITLE = re.compile("(?:" + "|".join(LINES + TITLES) + ")" + _REF + r"(?: (?:[-–—|·:]) .+)?$", re.IGNORECASE)
_MARKS, _FILLER = re.compile(MARKS), re.compile(FILLER)
#: Between two sentences.
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")


#: One of these stands in every mark, and three of these words in all filler of six: quick tests for whole texts.
_MARK_PARTS = ("{", "<", "@@", "%", "__", "[", "&lt;", "&#123;", "Invalid Date")
_FILLER_SET = frozenset(FILLER_WORDS)


@lru_cache(1)
def _partial() -> list[tuple[str, regex.Pattern]]:
    return [(p, regex.compile(p, regex.IGNORECASE)) for p in LINES]


@lru_cache(maxsize=50_000)
def _from(start: str) -> re.Pattern | None:
    """The messages that can begin with these characters, None if none can."""
    able = [p for p, r in _partial() if r.fullmatch(start, partial=True)]
    return re.compile("(?:" + "|".join(able) + ")" + _REF + "$", re.IGNORECASE) if able else None


def _message(text: str) -> bool:
    able = _from(text[:4].lower()) if len(text) > 4 else _LINE
    return able is not None and bool(able.match(text))


def evidence(text: str | None) -> list[str]:
    """The lines of a text that are or hold residues: a mark or filler anywhere, a message as the line or one of its
    sentences."""
    if not text:
        return []
    marks = any(p in text for p in _MARK_PARTS)
    filler = len(_FILLER_SET.intersection(text.lower().split())) >= 3
    out = []
    for raw in text.split("\n"):
        line = " ".join(raw.split())
        if not line:
            continue
        parts = _SENTENCES.split(line)
        if marks and _MARKS.search(line) or filler and _FILLER.search(line) or _message(line) or len(parts) > 1 and any(map(_message, parts)):
            out.append(raw)
    return out


def title_evidence(title: str | None) -> bool:
    title = " ".join((title or "").split())
    return bool(title and (_TITLE.match(title) or _MARKS.search(title) or _FILLER.search(title)))


def suspects(df: DataFrame, record: str, title: str, body: str, site: Column) -> DataFrame:
    """(record, site, by_title, evidence, body) of the pages with any evidence. No shuffle; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(x) for x in batch.column(3).to_pylist()]
            titled = [title_evidence(x) for x in batch.column(2).to_pylist()]
            keep = pa.array([bool(f) or t for f, t in zip(found, titled, strict=True)], pa.bool_())
            columns = [batch.column(0), batch.column(1), pa.array(titled, pa.bool_()), pa.array(found, pa.list_(pa.string())), batch.column(3)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["record", "site", "by_title", "evidence", "body"])

    ship(df.sparkSession)
    kind = df.schema[record].dataType.simpleString()
    rows = df.select(F.col(record).alias("record"), site.alias("site"), F.col(title).alias("title"), F.col(body).alias("body"))
    return spread(rows).mapInArrow(run, f"record {kind}, site string, by_title boolean, evidence array<string>, body string")


def line_hashes(body: Column) -> Column:
    """Hashes of a text's distinct normalised lines, blank ones left out; null for null."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(body, "\n"), normal_line), lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(df: DataFrame, body: str, site: Column) -> DataFrame:
    """(site, boiler): hashes of the lines that recur over a host; at most 100 / BOILER_PERCENT times the lines of a page.

    All lines are counted, with partial sums before the shuffle, so a host of any size is no hot spot. A repeated row
    counts as another page.
    """
    pages = df.where(F.col(body).isNotNull()).select(site.alias("site"), line_hashes(F.col(body)).alias("hashes")).where("site is not null")
    counts = pages.select("site", F.explode("hashes").alias("h")).groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BOILER_PAGES)
    sizes = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= BOILER_PAGES)
    return counts.join(sizes, "site").where(F.col("n") * 100 >= F.col("pages") * BOILER_PERCENT).groupBy("site").agg(F.collect_list("h").alias("boiler"))


def residues(df: DataFrame, record: str, title: str, body: str, site: Column) -> DataFrame:
    """(record) of the pages with evidence in the title or in the body less the boilerplate of the site.

    Null and empty fields hold no evidence. Pages without url belong to no site, so nothing is subtracted from them. A
    page of which nothing is left is judged whole. The join by site has no broadcast hint: Spark decides from the bytes
    written before, and splits a site of many suspects.
    """
    rows = materialize(suspects(df, record, title, body, site), "suspects")
    joined = rows.join(boilerplate(df, body, site), "site", "left")
    boiler = F.coalesce("boiler", F.array().cast("array<bigint>"))
    left = F.filter("evidence", lambda x: ~F.array_contains(boiler, F.xxhash64(normal_line(x))))
    nothing = F.size(F.array_except(line_hashes(F.col("body")), boiler)) == 0
    return joined.where(F.col("by_title") | (F.size(left) > 0) | (nothing & (F.size("evidence") > 0))).select(F.col("record").alias(record))
