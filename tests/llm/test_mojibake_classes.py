import pytest

from lakesearch.llm import mojibake as m

# one character of each class that cost() knows
SAMPLE = {"a": "q", "A": "Q", "d": "7", "s": " ", "p": ";", "x": "\x9d", "e": "é", "E": "É", "t": "”", "g": "©", "n": "\xa0", "c": "ж", "C": "Ж", "b": "│", "r": "→", "f": "，", "z": "茅", "Z": "鑼", "y": "ª", "k": "ђ", "B": "▓", "o": "ǝ"}


def test_samples_are_of_their_class():
    assert all(ord(c) in m._CLASS or m._CLASS[ord(c)] == k for k, c in SAMPLE.items())
    assert {k: m._CLASS[ord(c)] for k, c in SAMPLE.items()} == {k: k for k in SAMPLE}


@pytest.mark.parametrize("pair", sorted(p for p, w in m._TWO.items() if w))
def test_every_pair_reaches_the_search(pair, monkeypatch):
    """A line that one charged pair alone lifts to GAIN is searched (pairs of accented letters count in longer runs)."""
    seen = []
    monkeypatch.setattr(m, "search", lambda text, start: (seen.append(text), (text, start))[1])
    text = SAMPLE[pair[0]] + SAMPLE[pair[1]]
    line = text * 4 if pair in ("ee", "EE") else ";".join([text] * 9)
    m._known.cache_clear()
    m.repair(line)
    m._known.cache_clear()
    assert m.evidence(line) >= m.GAIN and line in seen


@pytest.mark.parametrize("kind", sorted(k for k in m._ONE if k not in m._ORDINARY))
def test_every_strange_class_counts(kind):
    assert m.evidence(SAMPLE[kind]) == m.cost(SAMPLE[kind]) >= m.GAIN


@pytest.mark.parametrize(
    ("bad", "good"),
    [
        ("un caf茅 au lait", "un café au lait"),
        ("M眉nchen", "München"),
        ("el ni帽o come", "el niño come"),
        ("Der Zug nach M眉nchen, vom Bahnhof 北京", "Der Zug nach München, vom Bahnhof 北京"),
        ("ein caf茅 in 北京", "ein café in 北京"),
        ("caf&Atilde;&copy; ouvert", "café ouvert"),
        ("Terms of use â€” Privacy", "Terms of use — Privacy"),
        ("Map 路 News 路 Archive 路 Search", "Map · News · Archive · Search"),
    ],
)
def test_repaired(bad, good):
    assert m.repair_text(bad) == (good, True)


@pytest.mark.parametrize(
    "text",
    [
        "caf&eacute; &amp; bar",
        "本网站使用Cookie和API接口，在iPhone上也可以用App打开",
        "用A用B用C用d用e用f",
        "Gasse | Bäckerei | Größe | Öfen | Körbe | " * 30,
        "温室 fast Ulmcroft, 温室 fast Ravham, 温室 fast Lunenstead, 温室 fast Calanby",
        "Где южный пруд?",
        "top музей free музей fast музей online музей",
        "LIGAÇÕES E AÇÃO, CORAÇÃO E NAÇÃO",
        "é" + " é" * 60,
    ],
)
def test_clean_stays(text):
    assert m.repair_text(text) == (text, False)


CLEAN_LINES = [
    "El señor explicó que la canción de la montaña se oye también en otoño.", "Die Größe der Körbe überraschte die Bäckerin, die früh öffnete.", "La régulière boîte a été mesurée près de la forêt après la fête.",
    "Немного о прошлом: старый мост у реки построили после наводнения.", "Жители посёлка просят, чтобы хор пел чаще, а рынок открывался раньше.", "从长沙湾走到平安镇要经过一处古老的邮局。", "It’s fine — really”, they said… and “left”.", "Não há maçã no salão, dizia o cartão da irmã.",
]
WRONG = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "koi8_r"), ("utf-8", "cp866"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("gb18030", "cp1252"), ("cp1252", "cp1251")]


def test_restored():
    """Texts wrongly decoded here come back: at least 0.9 of them exactly, and nearly all are found."""
    n = found = same = 0
    for line in CLEAN_LINES:
        assert m.repair_text(line) == (line, False)
        for right, wrong in WRONG:
            try:
                bad = line.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if bad != line:
                text, hit = m.repair_text(bad)
                n, found, same = n + 1, found + hit, same + (text == line)
    assert n > 25 and found >= 0.97 * n and same >= 0.9 * n


def test_more_search_changes_nothing(monkeypatch):
    """The search has no bound on states; a wider one for states dearer than the start gives the same texts."""
    bad = [x.encode("utf-8").decode("cp1252", "replace") for x in CLEAN_LINES[:3]] + [x.encode("cp1251").decode("koi8_r") for x in CLEAN_LINES[3:5]]
    first = [m._judged(x) for x in bad]
    monkeypatch.setattr(m, "SLACK", 6.0)
    m._known.cache_clear()
    assert [m._judged(x) for x in bad] == first
    m._known.cache_clear()
