import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.session import Engine
from tessera.sources import files, rdf, tables
from tessera.streaming.resume import answer_stream

TTL = """@prefix : <http://example.org/geographbg#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# върхове
:Мусала a :Връх ; rdfs:label "Мусала"@bg , "Я \\"x\\"" ; :находящСеВ :Рила ;
  :надморскаВисочина [ a :КоличественаСтойност ; :имаСтойност "2925.4"^^<http://www.w3.org/2001/XMLSchema#decimal> ; :имаМернаЕдиница :Метър ] .
:Вихрен a :Връх ; rdfs:label "Вихрен"@bg ; :надморскаВисочина [ :имаСтойност 2914 ; :имаМернаЕдиница :Метър ] ; :имаОписание \"\"\"два
реда\"\"\" .
:Рила a :Планина ; rdfs:label "Рила"@bg .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.ttl").write_text(":Рила a :Планина .")
    t = rdf.read_turtle(spark, str(tmp_path))
    rows = {tuple(r) for r in t.collect()}
    assert len(rows) == 16 and (v.NS + "Мусала", "uri", v.LABEL, 'Я "x"', "literal", None, None) in rows
    assert {r[3] for r in rows if r[2] == v.VALUE} == {"2925.4", "2914"} and any(r[3] == "два\nреда" for r in rows)
    out = str(tmp_path / "nt")
    rdf.write_ntriples(t, out)
    assert {tuple(r) for r in rdf.read_ntriples(spark, out).collect()} == rows
    assert [r[0] for r in rdf.instance_names(spark, str(tmp_path / "*.ttl")).collect()] == ["Вихрен", "Мусала", "Рила"]


@pytest.mark.parametrize("text", [":a :b", "x:y a :z .", ":a :b ~ .", ":a a ."])
def test_bad_turtle(text):
    with pytest.raises(rdf.TurtleError):
        rdf.parse_turtle(text)


def test_files(spark, tmp_path):
    page = lambda t, c="x": {"title": t, "content": c, "language": "bg"}
    (tmp_path / "fetched-a.json").write_text(json.dumps([page("A"), page("B")]))
    (tmp_path / "fetched-b.json").write_text(json.dumps([page("A", "later"), page(" "), page(None)]))
    (tmp_path / "fetched-c.json").write_text("[{no json")
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, [page("C"), page("B", "y")])) + "\n{bad\n")
    assert files.read_pages(spark, f"{tmp_path}/*.json", ["fetched-b.json"]).count() == 2
    got = {r.title: r.source_file for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"A": "fetched-a.json", "B": "d.jsonl", "C": "d.jsonl"}
    assert {r.title: r.n for r in files.read_folder_counted(spark, str(tmp_path))[1].collect()} == {"A": 2, "B": 2}
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "r.jsonl").write_text('{"question": "q", "answer": "A"}\nnope\n{"question": "q", "answer": "B"}\n')
    assert [r.answer for r in files.read_runs(spark, str(runs)).collect()] == ["B"]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.json").write_text(json.dumps({"data": {"geo": [{"url": "u", "questions": [{"id": "1", "qid": 2, "question": "q", "answers": ["a"], "correct": "a"}]}]}}))
    assert files.read_nested_questions(spark, str(tmp_path / "n"), "geo").first().url == "u"
    links = spark.createDataFrame([("r", "p0", False), ("r", "c", True), ("c", "p1", False), ("c", "r", True), ("c", "p0", False)], "parent string, member string, is_category boolean")
    assert {tuple(r) for r in files.category_members(links, "r").collect()} == {("p0", 0), ("p1", 1)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ask = lambda df: df.selectExpr("id", "upper(question) AS answer")
    run = lambda: answer_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ask).awaitTermination()
    (tmp_path / "in" / "1.json").write_text('{"id": "1", "question": "a"}\n{"id": "2", "question": "b"}\n')
    run()
    (tmp_path / "in" / "2.json").write_text('{"id": "2", "question": "changed"}\n{"id": "3", "question": "c"}\n')
    run()
    assert sorted((r.id, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "A"), ("2", "B"), ("3", "C")]


def test_engine(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    e = Engine(spark, str(tmp_path / "store"))
    assert e.load(str(tmp_path / "a.ttl")) == 16 and e.health()["graph"]
    texts = {r.text for r in e.facts().collect()}
    assert {"Мусала находящ Се В Рила", "Мусала е тип Връх", "Вихрен надморска Височина 2914 Метър"} <= texts
    e.ingest_facts("facts")
    assert e.query("facts", "Мусала находящ Се В Рила", 1).first().text == "Мусала находящ Се В Рила"
    with pytest.raises(ValueError):
        e.query("facts", "x", 1, "dot")
    with pytest.raises(ValueError):
        e.embeddings([])
    assert len(e.embeddings(["a", "b"])) == 2
    grown = e.expand("Колко е висок връх Вихрен?")
    assert "Вихрен надморска Височина 2914 Метър" in {r.text for r in grown.collect()}
    q = spark.createDataFrame([("1", "Къде е Мусала?", [("A", "Рила"), ("B", "Пирин")], "A"), ("2", "Нещо", [("A", "x"), ("B", "y")], "B")], "query_id string, question string, options array<struct<label:string,text:string>>, correct_answer string")
    got = {r.query_id: r for r in e.answer(q).collect()}
    assert got["1"].answer == "A" and got["1"].recall and got["2"].answer in "AB-"
    pages = spark.createDataFrame([(1, "Мусала", "Мусала е връх в Рила. == История == Стар.", "f")], "page_id bigint, title string, content string, source_file string")
    for strategy in ("fixed256", "structure", "parentchild"):
        assert {r.query_id for r in e.answer(q, pages, strategy).collect()} == {"1", "2"}
    assert e.add_turtle(spark.createDataFrame([("1", ":Нов a :Връх ."), ("2", "не")], "id string, text string")).first().triples == 1
    assert e.curate().count() == 7 and e.snapshot().count() == 6

    def fails(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["A"] * len(prompts)

    e.model = fails
    done = {r.query_id: r for r in e.generate(spark.createDataFrame([("1", "good"), ("2", "bad")], "query_id string, prompt string")).collect()}
    assert done["1"].reply == "A" and done["2"].error == "no"


def test_settled_tables_go_with_the_application(spark, monkeypatch):
    import os

    from tessera.sources import tables

    df = tables.settled(spark.range(5), "five")
    folder = tables._own_folder(spark).removeprefix("file://")
    assert df.count() == 5 and any(x.startswith("five-") for x in os.listdir(folder))

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    try:
        tables.shared_folder(Cluster)
        raise AssertionError("a machine-local folder on a cluster")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)


def test_turtle_is_written_with_backup(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    t = rdf.read_turtle(spark, str(tmp_path / "a.ttl"))
    out = str(tmp_path / "graph")
    assert rdf.write_turtle(t, out, dry_run=True) == {"triples": 16, "written": False, "backup": None} and not (tmp_path / "graph").exists()
    assert rdf.write_turtle(t, out)["triples"] == 16
    again = lambda p: {tuple(r) for r in rdf.read_turtle(spark, f"{p}/*.txt", scoped=False).collect()}
    assert again(out) == {tuple(r) for r in t.collect()}
    got = rdf.write_turtle(t.limit(3), out)
    assert got["triples"] == 3 and got["backup"] == out + ".bak-1" and len(again(got["backup"])) == 16
    with pytest.raises(FileExistsError):
        rdf.write_turtle(t, out, backup=False)


def test_replies_are_unfenced_repaired_and_classified(spark):
    known = spark.createDataFrame([(v.NS + "Мусала", "uri", v.TYPE, v.NS + "Връх", "uri", None, None)], rdf.TRIPLES)
    rows = [("1", "Ето:\n```turtle\n:Ботев a :Връх .\n:Мусала a :Връх .\n```"), ("2", ":X a owl:Class . :x geo:lat \"1\" ."), ("3", ":Вихрен a :Връх .\n:Рила rdfs:label \"нед"), ("4", "няма ~~"), ("5", None)]
    graph, counts, errors = rdf.merged_replies(spark.createDataFrame(rows, "id string, text string"), known)
    assert {r.kind: r.added for r in counts.collect()} == {"class": 1, "instance": 2, "triple": 4} and graph.count() == 5
    assert {r.id for r in errors.collect()} == {"4"}


def test_bindings_of_an_endpoint(spark):
    def fetch(query):
        if query == "bad":
            raise OSError
        row = {"s": {"type": "uri", "value": v.NS + "A"}, "p": {"type": "uri", "value": v.LABEL}, "o": {"type": "literal", "value": "А", "xml:lang": "bg"}}
        node = {"s": {"type": "uri", "value": v.NS + "A"}, "p": {"type": "uri", "value": v.NS + "r"}, "o": {"type": "bnode", "value": "b0"}}
        return json.dumps({"head": {"vars": ["s", "p", "o"]}, "results": {"bindings": [row, node, {"s": row["s"]}]}})

    got = {tuple(r) for r in rdf.endpoint_triples(spark.createDataFrame([("1", "q"), ("2", "bad")], "id string, query string"), fetch).collect()}
    assert got == {("1", v.NS + "A", "uri", v.LABEL, "А", "literal", None, "bg"), ("1", v.NS + "A", "uri", v.NS + "r", "_:b0", "bnode", None, None)}


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"т{i}", None) for i in range(20)], "n int, t string, x string").repartition(3)
    files.write_in_order(df, str(tmp_path / "o"), "n")
    lines = [json.loads(x) for p in sorted((tmp_path / "o").glob("part*")) for x in p.read_text().splitlines()]
    assert [x["n"] for x in lines] == list(range(20)) and "x" in lines[0]
    assert [r.n for r in files.read_benchmark(spark, str(tmp_path / "o"), 7).collect()] == list(range(7))
    files.write_pretty(df, str(tmp_path / "p"))
    lists = [json.loads(p.read_text()) for p in (tmp_path / "p").glob("part*")]
    assert sorted(x["n"] for y in lists for x in y) == list(range(20))
    parents = spark.createDataFrame([("f::t::s0::p0", "t", "s", "текст")], files.PARENT)
    files.write_parents(parents, str(tmp_path / "q"))
    assert files.read_parents(spark, str(tmp_path / "q")).collect() == parents.collect()
    (tmp_path / "list.json").write_text(json.dumps([{"title": "A", "content": "x"}, {"title": "A", "content": "y"}]))
    pages, repeated = files.read_page_list(spark, str(tmp_path / "list.json"))
    assert pages.count() == 2 and [tuple(r) for r in repeated.collect()] == [("A", 2)]


def test_settled_tables_leave_no_shuffle_files(spark):
    dirs = [Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {p.name for d in dirs for p in d.rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = there(), spark.conf.get(key, None)
    df = tables.settled(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")), "counts")
    end = time.time() + 20
    while there() - before and time.time() < end:
        time.sleep(0.1)
    assert not there() - before and spark.conf.get(key, None) == setting
    assert {(r.k, r.n) for r in df.collect()} == {(i, 100) for i in range(10)}
