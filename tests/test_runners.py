import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as v
from tessera.operators import chunking, dataset, graph, ranking, vectors
from tessera.plans import classic, rag, runners
from tests.test_operators import triples

QUESTION = "query_id string, question string, options array<struct<label:string,text:string>>, correct_answer string"
PAGE = "page_id bigint, title string, content string, source_file string"


@pytest.fixture(scope="module")
def peaks(spark):
    rows = [(v.NS + "надморскаВисочина", "uri", v.LABEL, "надморска височина", "literal"), (v.NS + "Метър", "uri", v.LABEL, "метра", "literal")]
    for n, (name, height) in enumerate((("Мусала", "2925.0"), ("Вихрен", "2914"), ("Ботев", "2376"))):
        s, node = v.NS + name, f"_:n{n}"
        rows += [(s, "uri", v.LABEL, name, "literal"), (s, "uri", v.TYPE, v.NS + "Връх", "uri"), (s, "uri", v.NS + "надморскаВисочина", node, "bnode"), (node, "bnode", v.VALUE, height, "literal"), (node, "bnode", v.UNIT, v.NS + "Метър", "uri")]
    return spark.createDataFrame([(*r, None, None) for r in rows], "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("1", "Каква е надморска височина на Мусала", [("A", "2925"), ("B", "1")], "A"), ("2", "Нещо съвсем друго", [("A", "x"), ("B", "y")], "B")], QUESTION)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "Мусала", "Мусала е висок 2925 метра. == История == Стар.", "f"), (2, "Друго", "съвсем друго y", "f")], PAGE)


def test_diagnostics_timings_reranker_and_abstention(peaks, asked):
    timings: dict = {}
    model = lambda q, t: [float("2376" in x) for x in t]
    options = rag.KgOptions(top_k=2, over_fetch=10, least=1, rerank=1, reranker=model, empty="abstain")
    got = {r.query_id: r for r in rag.answer_from_graph(asked, peaks, model=list, options=options, selector=lambda p: ["[]"] * len(p), timings=timings, diagnostics=True).collect()}
    assert set(timings) == {"retrieval", "expansion", "rerank", "filtering"} and runners.timing_sums([timings, timings])["total"] >= timings["retrieval"]
    assert got["1"].answer == "-" and got["1"].reply is None and got["1"].used_fallback and got["1"].kg_diag.n_filtered == 0 and got["1"].kg_diag.n_seeds >= 1 and got["1"].kg_diag.expanded_recall
    def told(part):  # beside the protected fact, the one that a model for pairs likes best is the context
        best = lambda q, t: [float(part in x) for x in t]
        options = rag.KgOptions(top_k=2, least=1, rerank=2, reranker=best)
        rows = rag.answer_from_graph(asked.filter("query_id = '1'"), peaks, model=list, options=options, selector=lambda p: [None] * len(p)).collect()
        return rows[0].reply.partition("Въпрос:")[0], rows[0].ctx_n

    typed, high = told("е тип"), told("2925")
    assert typed[1] == high[1] == 2 and "е тип" in typed[0] and "2925 метра" in high[0] and "е тип" not in high[0]


def test_models_of_pairs(spark):
    rows = [("q", "река Арда", str(i), t) for i, t in enumerate(["река Марица", "арда река", "нищо", None])]
    got = ranking.reranked(spark.createDataFrame(rows, "query_id string, query string, cand_id string, text string"), k=2).orderBy("rank").collect()
    assert [r.cand_id for r in got] == ["1", "0"]


def test_pipelines_side_by_side(peaks, asked, pages):
    got = {(r.pipeline, r.query_id): r for r in runners.compared_pipelines(asked, peaks, pages).collect()}
    assert {p for p, _ in got} == {"graph", "chunks", "both", "none"} and len(got) == 8
    assert got["graph", "1"].answer == "A" and got["both", "1"].answer == "A" and got["none", "1"].ctx_n == 0


def test_ablation_and_report(spark, asked, pages):
    flat = lambda df: df.select("text").withColumn("vector", F.array(F.lit(1.0).cast("float")))
    runs = runners.embedding_ablation(asked, pages, {"own": rag.hashed_vectors, "flat": flat}, ["structure", "parentchild"])
    assert runs.groupBy("embedder", "strategy").count().count() == 4 and runs.count() == 8
    never = runs.filter("embedder = 'own'").withColumn("answer", F.lit("-"))
    base = spark.createDataFrame([("1", "A"), ("2", "A")], "query_id string, answer string")
    got = {(r.strategy, r.variant): r for r in runners.strategy_report(never, base).collect()}
    assert got["structure", "raw"].accuracy == 0 and got["structure", "fallback"].accuracy == 50 and got["baseline", "alone"].accuracy == 50 and got["structure", "raw"].abstention == 100


def test_batches_merge_only_if_all_succeed(spark, tmp_path):
    q = spark.createDataFrame([(f"{i:03}", i) for i in range(25)], "query_id string, n int").repartition(3)
    calls = []

    def answer(df, bad=None):
        rows = sorted(r.query_id for r in df.collect())
        calls.append(rows)
        if bad in rows:
            raise RuntimeError("no")
        return df.select("query_id", F.lit("A").alias("answer"))

    merged, failed = runners.in_batches(q, lambda df: answer(df, "012"), str(tmp_path / "b"), 10)
    assert merged is None and failed == [1] and len(calls) == 3
    calls.clear()
    merged, failed = runners.in_batches(q, answer, str(tmp_path / "b"), 10)
    assert failed == [] and merged.count() == 25 and calls == [[f"{i:03}" for i in range(10, 20)]]


def test_older_variants(spark, peaks):
    doubled = peaks.unionByName(peaks.withColumn("s", F.when(F.col("s") == v.NS + "Ботев", v.NS + "Ботев2").otherwise(F.col("s"))))
    assert classic.all_facts(doubled).count() > graph.facts(doubled).count()
    lone = triples(spark, [("A", "label", "'А"), ("A", "надморскаВисочина", "_:x"), ("_:x", "имаМернаЕдиница", "Метър")])
    told = [r.text for r in classic.told_with_missing(lone).collect()]
    assert any(v.MISSING in t and "Метър" in t for t in told) and graph.facts(lone).count() == 0
    seeds = spark.createDataFrame([("q", v.NS + "Мусала")], "query_id string, node string")
    far = {r.s for r in classic.shared_frontier(seeds, peaks).collect()}
    assert v.NS + "Вихрен" in far  # by way of the type
    assert classic.shared_frontier(seeds, peaks, each=1).filter("hop = 1").count() == 1
    hits = spark.createDataFrame([("q", "река река река Арда", "1", "река", 0.5, v.NS + "x", None, 5), ("q", "река река река Арда", "2", "Арда", 0.5, v.NS + "x", None, 5)], "query_id string, query string, cand_id string, text string, distance double, predicate_uri string, object_uri string, predicate_importance int")
    best = classic.reranked_uncapped(hits).orderBy("rank").collect()
    assert [r.cand_id for r in best] == ["1", "2"] and abs(best[0].score - best[1].score - 16) < 1e-9
    cands = spark.createDataFrame([("q", 1, "а"), ("q", 2, "б")], "query_id string, rank int, text string")
    replies = lambda t: spark.createDataFrame([("q", t)], "query_id string, reply string")
    assert [r.text for r in classic.filtered(replies('["б"]'), cands).collect()] == ["б"]
    assert {r.text for r in classic.filtered(replies('["б", 3]'), cands).collect()} == {"а", "б"}
    store = vectors.Store(spark)
    texts = spark.createDataFrame([("едно",), ("две",)], "text string")
    assert classic.ingested(texts, rag.hashed_vectors, store, "c") == 2 and store.metric("c") == "l2" and sorted(r.vec_id for r in store.read("c").collect()) == [0, 1]
    q = rag.hashed_vectors(spark.createDataFrame([("две",)], "text string")).select(F.lit(7).cast("bigint").alias("query_id"), F.col("vector").alias("embedding"))
    found = classic.plain_retrieval(q, store.read("c"), 1).join(store.read("c"), "vec_id").first()
    assert found.text == "две"
    with pytest.raises(ValueError):
        store.search("c", q, 1, "cosine")
    store.change_metric("c", "cosine")
    assert store.search("c", q, 1, "cosine").count() == 1 and store.dump("c").columns == ["text", "vector"]
    facts = store.read("c").select("vec_id", "text", F.lit(v.NS + "x").alias("predicate_uri"), F.lit(None).cast("string").alias("object_uri"), F.lit(3).alias("predicate_importance"))
    assert classic.retrieved_and_reranked(q.withColumn("query", F.lit("две")), store.read("c"), facts, 1).first().text == "две"
    prompt, seconds = classic.prompt_with_timings(["факт"], "Какво?")
    assert "1. факт" in prompt and "Какво?" in prompt and seconds["prompt"] >= 0


def test_own_chunkers_and_scorers(spark, peaks, pages, monkeypatch):
    lines = lambda p: p.select("page_id", "title", "source_file", F.lit(0).alias("chunk_index"), F.substring("content", 1, 10).alias("text"))
    monkeypatch.setitem(chunking.STRATEGIES, "first10", chunking.Strategy(lines))
    assert {r.text for r in chunking.chunked(pages, "first10").collect()} == {"Мусала е в", "съвсем дру"}
    seeds = spark.createDataFrame([("q", "x", 1, v.NS + "Мусала")], "query_id string, query string, rank int, node string")
    got = graph.beam_expansion(seeds, peaks, None, hops=1, beam=1, model=lambda q, t: [float("тип" in x) for x in t]).collect()
    assert [r.text for r in got] == ["Мусала е тип Връх"] and got[0].score == 1.0


def test_baseline_keeps_the_order(spark):
    q = spark.createDataFrame([(i, str(9 - i), f"въпрос {i}", [("A", "x")], "A") for i in range(10)], "place int, " + QUESTION).repartition(3)

    def model(prompts):
        if any("въпрос 3" in p for p in prompts):
            raise RuntimeError("no")
        return ["A" if "въпрос 1" in p else "B" for p in prompts]

    got = runners.baseline(q, model, "place", workers=4).collect()
    assert [r.place for r in got] == list(range(10)) and [r.answer for r in got] == ["B", "A", "B", "-"] + ["B"] * 6 and got[3].error == "no"


def test_merging_and_annotation(spark):
    a = spark.createDataFrame([("1", "Кой е това?"), ("2", "кой е това"), ("3", None)], "id string, question string")
    rows, counts = dataset.merged_batches(a.unionByName(a))
    assert rows.count() == 6 and tuple(counts.first()) == (6, 2) and dataset.merged_batches(a.unionByName(a), order=["id"], dedupe=True)[0].count() == 3
    got = {r.id: r.known for r in dataset.annotated(a, spark.createDataFrame([("КОЙ е  това!",)], "question string")).collect()}
    assert got == {"1": True, "2": True, "3": False}
    strata = spark.createDataFrame([(str(i), "abc"[i % 3]) for i in range(100)], "id string, s string")
    assert dataset.stratified(strata, "s", "id", 10).count() == 10 and dataset.stratified(strata, "s", "id", 200).count() == 100
