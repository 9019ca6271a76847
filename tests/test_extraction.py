from tessera.operators import extraction as X
from tessera.plans import rag


def test_selected(spark):
    c = spark.createDataFrame([(q, i, t) for q in "abcde" for i, t in enumerate(["един", "два", "три"])], "query_id string, rank int, text string")
    r = spark.createDataFrame([("a", 'Ето: ["2. два", "\\"един\\"", "четири"]'), ("b", "['три', \"един\"]"), ("c", "[]"), ("d", "не знам"), ("e", None)], "query_id string, reply string")
    got = {}
    for x in X.selected(r, c).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append((x.text, x.used))
    assert got == {"a": [("два", True), ("един", True)], "b": [("три", True), ("един", True)], "d": [(t, False) for t in ("един", "два", "три")], "e": [(t, False) for t in ("един", "два", "три")]}


def test_extraction_pages(spark):
    t = spark.createDataFrame([("Рила", None, [("f", "Рила"), ("f", "x")]), ("Пирин", False, [("f", "Пирин")]), ("Вит ", True, [("f", "Вит")]), ("Няма", True, []), ("Друг", True, [("g", "Рила")])], "term string, fetchable boolean, source_pages array<struct<file:string,title:string>>")
    p = spark.createDataFrame([("f", "Рила", "'''Рила''' {{x}}"), ("f", "Вит", "река"), ("f", "Пирин", "x")], "source_file string, title string, content string")
    done = spark.createDataFrame([("вит",)], "label string")
    assert [(r.term, r.text) for r in X.extraction_pages(t, p, done).collect()] == [("Рила", "Рила")]


def test_zero_shot(spark):
    items = spark.createDataFrame([("1", "p", {"m": "A"}), ("2", "p", {"m": ""}), ("3", "p", None)], "id string, prompt string, model_answers map<string,string>")
    got = {r.id: r.model_answers for r in X.zero_shot(items, {"m": lambda p: ["B"] * len(p), "n": lambda p: ["C"] * len(p)}, rag.asked).collect()}
    assert got == {"1": {"m": "A", "n": "C"}, "2": {"m": "B", "n": "C"}, "3": {"m": "B", "n": "C"}}


def test_diagnostics_and_articles(spark):
    d = spark.createDataFrame([(1, True, 0.125)], "n int, used boolean, s double").select(X.diagnostics(["n"], ["used"], ["s"]).alias("d")).first().d
    assert d.n == 1 and d.timings_s.s == 0.12
    p = spark.createDataFrame([("a", 'б (в)\n"г"', "bg"), ("b", " (x) ", "bg"), ("c", None, "bg")], "title string, content string, language string")
    assert [tuple(r) for r in X.article_rows(p).collect()] == [("a", "б г", "bg")]
