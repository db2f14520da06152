"""Residues, heaps and main bodies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesearch.functions import urls
from lakesearch.llm import mainbody, residue, stuffing

STORY = "In Harlow the word script means handwriting, and the clerk requires scripts to be enabled by the council. "
TOLD = "When the catalogue answered “404 not found” 52 times in a week, the librarian kept a list of every lost address."
RESIDUES = [
    "{{headline}}", "Hello {{ name }}, the rest is fine and the sentence goes on.", "<?php echo $x; ?>", "Dear &lt;name&gt;, welcome back", "[object Object] [object Object]", "undefined undefined", "Price: NaN",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "Your content here. Your content here.", "Sorry, nothing here.", "The requested address was not found on this server. (ref 12)", "Страница не найдена", "ОШИБКА 404. Запрошенная страница не существует.",
    "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "请启用 JavaScript 后再访问本页。", "Checking your browser before letting you through.", "You do not have permission to open this address.", "Traceback (most recent call last):", "500 Internal Server Error", "%%TITLE%%", "${title}",
]


@pytest.mark.parametrize("line", RESIDUES)
def test_residue(line):
    assert residue.evidence(f"News | Home\n{line}\nfooter") == [line]


@pytest.mark.parametrize("line", [STORY, TOLD, "A page on “{{braces}}” in templates.", "Not found guilty, the baker went home to the village.", "100% ORIGINAL", "Comments (0)", "", "x" * 100_000])
def test_no_residue(line):
    assert residue.evidence(line) == []


@pytest.mark.parametrize("line", ["The next tour of [YOUR TOWN HERE] starts soon.", "Only %(count)d left in stock today.", "Last changed by {0} on {1}.", "A story of the town. Sorry, nothing here. The rest follows.", "word " * 200 + "{{headline}}"])
def test_residue_inside_a_line(line):
    assert residue.evidence("Menu\n" + line) == [line]


def test_titles():
    for t in ("404 Not Found", "Error", "Error 503 - Some Journal", "Sample Page", "Loading…", "{{ page.title }} | Journal", "Just a moment..."):
        assert residue.title_evidence(t)
    for t in ("Errors of the past", "How the baker found a page", "", None):
        assert not residue.title_evidence(t)


def test_boilerplate_is_subtracted(spark):
    rows = [(i, "https://a.example/", "t", f"story {i} of the place\nPlease  enable JavaScript to view this page.") for i in range(20)]
    # a host that mostly answers with one message: nothing else is left of these pages, so they are residues
    rows += [(30 + i, "https://wall.example/", "t", "Menu\nPlease enable JavaScript to view this page.") for i in range(20)]
    rows += [(20, "https://b.example/", "t", "Please enable JavaScript to view this page."), (21, "https://a.example/", "Error", "x"), (22, None, None, "Sorry, nothing here."), (23, "https://a.example/", None, None), (24, "https://a.example/", "", "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, url string, title string, body_text string, site string")
    got = sorted(r.doc_id for r in residue.residues(df, "doc_id", "title", "body_text", urls.site(F.col("url"))).collect())
    assert got == [20, 21, 22, *range(30, 50)]
    # without subtraction every page with the notice would be found
    assert len({r.record for r in residue.suspects(df, "doc_id", "title", "body_text", urls.site(F.col("url"))).collect()}) == len(got) + 20
    assert residue.residues(df.limit(0), "doc_id", "title", "body_text", urls.site(F.col("url"))).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_repeat_lengths(seed):
    random.seed(seed)
    tokens = [random.choice("abc") for _ in range(random.randrange(40))]
    got = stuffing.repeat_lengths(tokens)
    for i in range(len(tokens)):
        best = 0
        for n in range(1, i + 2):
            part = tokens[i - n + 1 : i + 1]
            if sum(tokens[j : j + n] == part for j in range(len(tokens) - n + 1)) > 1:
                best = n
        assert got[i] == best


def words(n, seed=1):
    random.seed(seed)
    return random.choices("varnish wholesale cheap bridge online ledger free discount hammer".split(), k=n)


PROSE = "The walk from Harlow to the shallow weir takes an hour, and nobody minds the rain. Two volunteers mended the tram at the station on a cold Monday. Readers sent letters to ask why the old mill had not been opened yet. "

PROSE2 = "Compared with the coast, the garden here is sheltered and the plums ripen early. A famous kiln costs about nine hundred crowns, with tools lent by the museum. Our visit began with an old rope, a seed and many pages of notes. "
PROSE3 = "Below the bridge the current runs past a polished stone that someone measured last spring. If the lock freezes, the bright boat is lifted and the towpath stays shut. Each basket in the collection carries a narrow label with a number. "


def test_heaps():
    assert stuffing.is_heap("cheap varnish", ", ".join(words(150)), 3)
    assert stuffing.is_heap(None, "\n".join(f"{a} {b} -{i}%" for i, (a, b) in enumerate(zip(words(60), words(60, 2)))), 0)
    assert stuffing.is_heap("x", "\n".join(f"{a} best (https://{b}.example/{a}-{i})" for i, (a, b) in enumerate(zip(words(40), words(40, 3)))), 40)
    assert stuffing.is_heap("x", PROSE[:80] + "\n" + " | ".join(words(200)), 0)
    assert stuffing.is_heap("buy", "Our varnish is the cheap varnish for varnish fans. Looking for varnish? Varnish cheap, varnish free. Buy cheap varnish in Harlow. " * 12, 0)


def test_no_heaps():
    assert not stuffing.is_heap("t", PROSE * 2, 5)
    glossary = "\n".join(f"{w} — {s}." for w, s in zip("abcdefgh", PROSE.split(". ") * 4))
    assert not stuffing.is_heap("glossary", glossary, 8)
    for body in (None, "", "short", "Sorry, nothing here."):
        assert not stuffing.is_heap(None, body, 0)


def test_heap_rows(spark):
    df = spark.createDataFrame([(1, "t", ", ".join(words(150)), ["a", None]), (2, None, None, None), (3, "t", PROSE, []), (4, None, " | ".join(words(20_000)), None)], "doc_id bigint, title string, body_text string, outlinks array<string>")
    assert sorted(r.doc_id for r in stuffing.heaps(df, "doc_id", "title", "body_text", "outlinks").collect()) == [1, 4]
    assert stuffing.heaps(df.limit(0), "doc_id", "title", "body_text", "outlinks").collect() == []


MENU, NOTICES = "Home | News | Shop | Contact", ["We use cookies to keep this site working. Agree", "Share this page: mail, print, copy link"]
LABELS, HEADLINES = "Related stories", ["How {} mended its tram", "The shallow weir of {}", "{}: a rusty lamp"]
HEADINGS = ["What happened to the {}", "A word on the {}"]
NAMES = "Harlow Tarnby Lunford Merwick Ostgate Pelham Quilby Ravness Selport Thelby".split()
THINGS = "mill tram weir lamp kiln rope seed basket".split()


def corpus(n=60, seed=4):
    """Pages of several sites, [(line, kept)]: paragraphs of their own, furniture before, between and after them."""
    random.seed(seed)

    def paragraph():
        return " ".join(f"{random.choice(NAMES)} {random.choice(['sold', 'saw', 'lost'])} the {random.choice(THINGS)} {random.randrange(9999)} days after the rain, near {random.choice(NAMES)}." for _ in range(3))

    out = []
    for i in range(n):
        name, page = random.choice(NAMES), [(MENU, 0)] if random.random() < 0.8 else []
        page += [(f"By {random.choice(NAMES)} {random.choice(NAMES)}, {name} Journal desk", 0)] if random.random() < 0.8 else []
        page += [(NOTICES[0], 0)] if random.random() < 0.5 else []
        for k in range(3):
            page += [(random.choice(HEADINGS).format(random.choice(THINGS)), 1)] if random.random() < 0.6 else []
            page += [(paragraph(), 1)]
            if k < 2 and random.random() < 0.3:
                page += [(NOTICES[1], 0)]
        page += [(NOTICES[1], 0)] if random.random() < 0.6 else []
        page += [(LABELS, 0)] + [(h.format(random.choice(NAMES)), 0) for h in random.sample(HEADLINES, 2)] if random.random() < 0.7 else []
        page += [("", 1), (f"© {2000 + i % 9} {name} Journal. All rights reserved.", 0)]
        out.append(page)
    return out


def votes_of(pages):
    sums = {}
    for page in pages:
        for form, outside, inside, bit in mainbody.observe("\n".join(x for x, _ in page)):
            o, i, b = sums.get(form, (0, 0, 0))
            sums[form] = o + outside, i + inside, b | bit
    known = {f: (100 if not o + i else round((o + 0.5) * 100 / (o + i + 1)), min(o + i, 255) or 6) for f, (o, i, b) in sums.items() if o + i >= mainbody.LEAST_WHOLE or b.bit_count() >= mainbody.COPIES}
    votes = mainbody.Votes(np.zeros(0, np.int64), np.zeros((2, 0), np.uint8))
    votes.known = known
    return votes


def test_furniture():
    pages = corpus()
    votes = votes_of(pages)
    wanted = got = both = 0
    for page in pages:
        want = {i for i, (x, keep) in enumerate(page, 1) if not keep}
        found = set(mainbody.furniture("\n".join(x for x, _ in page), votes))
        wanted, got, both = wanted + len(want), got + len(found), both + len(want & found)
    assert both >= 0.98 * wanted and both >= 0.97 * got
    page = pages[0]
    marked = "\n".join(f"<p>{x}</p>" if x else "" for x, _ in page)
    assert mainbody.furniture(marked, votes) == mainbody.furniture("\n".join(x for x, _ in page), votes)
    assert mainbody.furniture("Home\nNews\n© 2024 X", votes) is None and mainbody.furniture("", votes) is None


def test_surge_and_dive_alone():
    """With nothing learned, what stands before and after the body is still found."""
    votes = mainbody.Votes(np.zeros(0, np.int64), np.zeros((2, 0), np.uint8))
    body = "\n".join([MENU, PROSE.strip(), PROSE2.strip(), "Related stories", PROSE3.strip(), "Tags: mill, weir"])
    assert mainbody.furniture(body, votes) == [1, 6]


def test_long_notices_are_furniture():
    """A notice as long as a paragraph is known by the different bodies that it stands in; a refetched page isn't."""
    notice = "No part of this journal may be copied, stored or passed on without the written consent of the publisher, who answers letters within two weeks of their arrival. " * 2
    pages = [[*page, (notice.strip(), 0)] for page in corpus(40)]
    votes = votes_of(pages)
    page = pages[3]
    assert len(page) in mainbody.furniture("\n".join(x for x, _ in page), votes)
    again = [pages[5]] * 20
    assert all(votes_of(again)(x, mainbody.plain(x)[1]) is None for x, keep in pages[5] if keep and len(x) > 150)


def test_body_rows(spark):
    pages = corpus()
    rows = [(i, "t", "\n".join(x for x, _ in page), None) for i, page in enumerate(pages)]
    rows += [(1002, None, None, []), (1003, "x", ", ".join(words(200)), []), (1004, "", " \n ", [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, title string, body_text string, outlinks array<string>, form int, outside string")
    args = (df, "doc_id", "title", "body_text", "outlinks")
    votes = votes_of(pages)
    want = {(i, n) for i, page in enumerate(pages) for n in mainbody.furniture("\n".join(x for x, _ in page), votes)}
    assert {(r.doc_id, r.line_no) for r in mainbody.furniture_lines(*args).collect()} == want
    texts = {r.doc_id: r.body for r in mainbody.main_text(*args).collect()}
    assert texts == {i: "\n".join(x for n, (x, _) in enumerate(page, 1) if x and (i, n) not in want) for i, page in enumerate(pages)}
    assert mainbody.furniture_lines(df.limit(0), *args[1:]).collect() == []


def test_coverage_and_clauses_decide_together():
    """The same loose lines are a heap with repeats and none without; enough clauses outweigh the repeats."""
    lists = "\n".join(f"{w} {i}" for i, w in enumerate("varnish hammer ledger bridge copper lantern pillow saddle".split()))
    repeated = "\n".join(["varnish best price", "hammer best price", "ledger best price"] * 12)
    assert stuffing.weight(None, repeated, 0) > 0 >= stuffing.weight(None, lists, 0)
    assert stuffing.weight(None, repeated + "\n" + PROSE + PROSE2 + PROSE3, 0) < 0 < stuffing.weight(None, repeated + "\n" + PROSE[:80], 0) or stuffing.weight(None, repeated + "\n" + PROSE + PROSE2 + PROSE3, 0) == 0
    assert stuffing.weight(None, "cheap varnish " * 12, 0) > 0  # short, but a heap
    for body in (PROSE, repeated, lists, PROSE * 3):
        assert (stuffing.weight(None, body, 0, sure=True) > 0) == (stuffing.weight(None, body, 0) > 0)
