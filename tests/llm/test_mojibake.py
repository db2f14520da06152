import pytest

from lakesearch.llm import mojibake as m

CLEAN = [
    "“It’s fine — really”, they said… © 2024 Café «Été» naïve",
    "NÃO HÁ canção EM Lisboa, dizia o cartão, e SÃO 12 DEGRAUS até à estação. A ÂNCORA e o ÓRGÃO",
    "Während die Brücke ruhte, hat die große Straße über 734 Häuser – „Wir möchten“",
    "¿Quién recuerda la película? El señor añadió una canción más pequeña. ¡Ñandú!",
    "Самый тихий дневник у посёлка был НАЙДЕН лишь через 12 лет. Все права защищены",
    "据青山说，一共有1205座安静的档案馆，其中一半已经记录。本网站使用 Cookie",
    "├── maps\n│   └── notes",
    "#bestфонарь #discountамбар",
    "← Viña (Porto) / Película, rústica, Lugo →",
    "plain ascii &amp; entities",
]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("cp1252", "mac_roman")]
WESTERN = ["La pépinière pavée rouvrira grâce à Zoé, près de la rivière", "Für 12 Kronen bekommt man eine kühle Wäsche und schöne Öfen", "El señor explicó que la música rápida sería más pequeña"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_stays(text):
    assert m.repair_text(text) == (text, False)


@pytest.mark.parametrize("text", WESTERN)
@pytest.mark.parametrize(("right", "wrong"), WRONG)
def test_western(text, right, wrong):
    assert m.repair_text(text.encode(right).decode(wrong, "replace" if wrong == "cp1252" else "strict")) [1]
    try:
        bad = text.encode(right).decode(wrong)
    except UnicodeDecodeError:
        return
    assert m.repair_text(bad) == (text, True)


@pytest.mark.parametrize(("right", "wrong"), [("utf-8", "cp866"), ("utf-8", "latin-1"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "latin-1")])
def test_russian(right, wrong):
    text = "Самый деревянный сарай у посёлка был сохранён лишь через много лет"
    assert m.repair_text(text.encode(right).decode(wrong)) == (text, True)


def test_chinese():
    text = "据林青舟说，桃云塘一共有结实的渡船，其中一半已经记录"
    assert m.repair_text(text.encode("gbk").decode("latin-1")) == (text, True)
    assert m.repair_text(text.encode().decode("gbk", "replace"))[1]


def test_twice_and_parts():
    text = "Après la fête, la crème brûlée"
    assert m.repair_text(text.encode().decode("cp1252", "ignore").encode().decode("latin-1"))[1]
    mixed = "good line é\n" + "Où est la forêt dorée".encode().decode("latin-1") + "\nanother"
    assert m.repair_text(mixed) == ("good line é\nOù est la forêt dorée\nanother", True)


def test_lost_text_counts():
    assert m.repair_text("La red m�s p�blica")[1]
    assert m.repair_text(None) == (None, False) and m.repair_text("") == ("", False)


def test_rows(spark):
    bad = "Où est la forêt dorée".encode().decode("latin-1")
    df = spark.createDataFrame([(1, bad, "x" * 300_000), (2, None, bad), (3, "ok", None), (4, "m�s", "ok")], "doc_id bigint, title string, body_text string")
    got = {(r.doc_id, r.field_name): (r.restored, r.recovered) for r in m.restore(df, "doc_id", ["title", "body_text"]).collect()}
    assert got == {(1, "title"): ("Où est la forêt dorée", True), (2, "body_text"): ("Où est la forêt dorée", True), (4, "title"): ("m�s", False)}
    assert m.restore(df.limit(0), "doc_id", ["title"]).collect() == []
