from tessera.functions import vocabulary as v
from tessera.plans import rag

TRIPLES = "s string, s_kind string, p string, o string, o_kind string"
HEIGHT = v.NS + "надморскаВисочина"


def test_stages_of_the_graph_pipeline(spark):
    rows = [(HEIGHT, "uri", v.LABEL, "надморска височина", "literal"), (v.NS + "Връх", "uri", v.LABEL, "Връх", "literal"), (v.NS + "Метър", "uri", v.LABEL, "метра", "literal")]
    for n, (name, height) in enumerate((("Мусала", "2925"), ("Вихрен", "2914"), ("Ботев", "2376"))):
        s, node = v.NS + name, f"_:n{n}"
        rows += [(s, "uri", v.LABEL, name, "literal"), (s, "uri", v.TYPE, v.NS + "Връх", "uri"), (s, "uri", HEIGHT, node, "bnode"), (node, "bnode", v.VALUE, height, "literal"), (node, "bnode", v.UNIT, v.NS + "Метър", "uri")]
    # the types' own edges aren't followed far enough here to reach the other peaks
    rows = [r for r in rows if not (r[2] == v.TYPE and r[0] != v.NS + "Мусала")]
    triples = spark.createDataFrame([(*r, None, None) for r in rows], TRIPLES + ", o_datatype string, o_lang string")
    q = spark.createDataFrame([("1", "Каква е надморска височина на Мусала", [("A", "2925"), ("B", "1")], "A")], "query_id string, question string, options array<struct<label:string,text:string>>, correct_answer string")
    options = rag.KgOptions(top_k=1, over_fetch=10, least=2)
    told = rag.answer_from_graph(q, triples, model=list, options=options, selector=lambda p: [None] * len(p)).first()
    assert "Вихрен надморска височина 2914 метра" in told.reply and "Ботев надморска височина 2376 метра" in told.reply and told.recall
    one = rag.answer_from_graph(q, triples, model=list, options=options, selector=lambda p: ['["Ботев надморска височина 2376 метра"]'] * len(p)).first()
    assert one.ctx_n == 2 and not one.used_fallback and "2376" in one.reply
    none = rag.answer_from_graph(q, triples, model=list, options=options, selector=lambda p: ["[]"] * len(p)).first()
    assert none.used_fallback and none.ctx_n > 2
