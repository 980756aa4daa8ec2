from kindredge.llm.language import identify

PROSE = {"en": "the house and the river of the old town with this and that", "de": "das haus und der fluss der alten stadt mit dem und nicht", "fr": "la maison et la riviere de la vieille ville avec les une", "es": "la casa y el rio de la ciudad vieja con los una que"}


def test_evidence(spark):
    docs = spark.createDataFrame([(t * 20, lang) for lang, t in PROSE.items()] + [(None, "en"), ("noise", None), ("noise", "xx")], "text string, lang string")
    page = lambda lang, body: f'<!DOCTYPE html><html lang="{lang}"><head><script>var the="the and of the";</script></head><body>{body}</body></html>'
    rows = [(i, f"https://{lang}{i % 2}.example.{'org' if lang == 'en' else lang}/p{i}", page(lang, PROSE[lang] * 3)) for i, lang in enumerate(["en", "de", "fr", "es"] * 10)]
    rows += [(100, "https://de1.example.de/short", "<html><body>ab</body></html>"), (101, "https://nowhere.example.xyz/", page("fr", "")), (102, "https://en0.example.org/wrong", page("fr", PROSE["en"] * 5)), (103, None, None), (104, "not a url", ""), (None, "https://x.example.de/", page("de", PROSE["de"])), (0, rows[0][1], rows[0][2]), (105, "https://long.example.es/", page("es", PROSE["es"] * 5000))]
    got = identify(spark.createDataFrame([(*x, "q") for x in rows], "page_id long, url string, html string, lang string"), docs).collect()
    assert len(got) == len(rows)
    lang = {x.page_id: x.lang for x in got}
    assert all(lang[i] == ["en", "de", "fr", "es"][i % 4] for i in range(40))
    assert lang[100] == "de" and lang[101] == "fr" and lang[102] == "en" and lang[None] == "de" and lang[105] == "es"
    assert all(0 < x.confidence <= 1 for x in got) and {x.host for x in got if x.page_id in (103, 104)} == {""}


def test_empty(spark):
    docs, pages = spark.createDataFrame([], "text string, lang string"), spark.createDataFrame([], "page_id long, url string, html string")
    assert identify(pages, docs).count() == 0
    assert identify(spark.createDataFrame([(1, "http://a.de/", "<p>x")], pages.schema), docs).count() == 1
