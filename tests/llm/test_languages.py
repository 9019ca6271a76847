import pytest

from tessera.llm import languages as L
from tests.llm.conftest import clashing

TEXTS = {
    "bg": "Реката извира от планината и се влива в морето. Селището е основано през миналия век, когато идват заселници. Климатът тук е мек, а почвите са плодородни.",
    "en": "The river rises in the mountains and flows into the sea. The village was founded in the last century when settlers arrived. The climate here is mild and the soils are fertile.",
    "ru": "Река берёт начало в горах и впадает в море. Посёлок был основан в прошлом веке, когда пришли переселенцы. Климат здесь мягкий, а почвы плодородные.",
    "mk": "Реката извира од планината и се влева во морето. Населбата била основана во минатиот век, кога дошле доселеници. Климата овде е блага, а почвите се плодни.",
    "de": "Der Fluss entspringt in den Bergen und mündet in das Meer. Das Dorf wurde im letzten Jahrhundert gegründet, als Siedler kamen. Das Klima hier ist mild und die Böden sind fruchtbar.",
    "fr": "La rivière prend sa source dans les montagnes et se jette dans la mer. Le village fut fondé au siècle dernier, quand des colons arrivèrent. Le climat est doux et les sols sont fertiles.",
    "es": "El río nace en las montañas y desemboca en el mar. El pueblo fue fundado en el siglo pasado, cuando llegaron los colonos. El clima aquí es suave y los suelos son fértiles.",
}


@pytest.fixture(scope="module")
def scores():
    return L.fitted([(t, c) for c, t in TEXTS.items()] * 10)


def test_names():
    assert [L.named(x) for x in ("BG", "bg-BG", "bul", "Bulgarian", " български ", "en_US", "ukr", "uk", "", None, "und", "??", "fr-FR")] == ["bg", "bg", "bg", "bg", "bg", "en", None, None, None, None, None, None, "fr"]


def test_found(spark, scores):
    long_mixed = TEXTS["bg"] + "\n" + TEXTS["en"]
    rows = [(1, TEXTS["bg"], "bg"), (2, TEXTS["bg"], "mk"), (3, TEXTS["mk"], None), (4, TEXTS["de"], "DEU"), (5, long_mixed, "bg-BG"), (6, TEXTS["ru"] + " The river rises.", "ru"), (7, "1 2 3 4 5 6 7 8 9", None), (8, None, None), (9, "", "en"), (10, "Река в планина.", None), (11, TEXTS["fr"] * 3000, "es"), (None, TEXTS["es"], None), (1, TEXTS["bg"], "bg")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {tuple(r) for r in L.found(df, scores).collect()}
    assert {x for x in got if x[0] != 5} == {(2, "label", "bg"), (3, "label", "mk"), (11, "label", "fr")}
    assert {x for x in got if x[0] == 5 and x[1] == "segment"} == {(5, "segment", "bg"), (5, "segment", "en")}
    spans = {r.doc_id: r for r in L.languages(df, scores).collect()}
    assert spans[1].lang == "bg" and 0.5 < spans[1].confidence <= 1 and [s.lang for s in spans[5].segments] == ["bg", "en"] and spans[8].lang is None and spans[7].confidence == 0
    assert L.found(df.limit(0), scores).count() == 0


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if r.text and L.named(r.lang)]
    fit = L.fitted([(t, L.named(g)) for i, t, g in rows if i % 2])
    got = {r.doc_id: r.lang for r in L.languages(docs, fit).collect()}
    own = [got[i] == L.named(g) for i, t, g in rows if not i % 2 and len(t.split()) > 30]
    # some labels are wrong on purpose
    assert sum(own) / len(own) > 0.75


def test_no_labels(spark):
    df = spark.createDataFrame([(1, TEXTS["bg"], None)], "doc_id bigint, text string, lang string")
    assert L.languages(df).count() == 1


def test_accuracy_and_calibration_on_planted_rows(spark, data):
    import random
    import re

    # a sample half as large as that of a whole corpus
    rnd = random.Random(11)
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    fit = L.fitted([(r.text, L.named(r.lang)) for r in docs.collect() if r.text and L.named(r.lang)])
    parts = {c: re.split(r"(?<=[.])\s+", t) for c, t in TEXTS.items()}
    rows = []
    for i in range(700):
        c = list(TEXTS)[i % 7]
        own = [rnd.choice(parts[c]) for _ in range(rnd.randint(1, 4))]
        if rnd.random() < 0.3:
            own.insert(rnd.randrange(len(own) + 1), "12,5 % 1908 3 400")
        rows.append((i, " ".join(own), c))
    got = {r.doc_id: r for r in L.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), fit).collect()}
    right = [got[i].lang == c for i, _, c in rows]
    sure = [got[i].lang == c for i, _, c in rows if got[i].confidence >= 0.9]
    assert sum(right) / len(right) >= 0.95 and len(sure) > 0.3 * len(rows) and sum(sure) / len(sure) >= 0.98
