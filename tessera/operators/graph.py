"""Triples as a graph: labels, types, sentences for facts, degrees, neighbourhoods and subgraphs.

Triples are rows (s, s_kind, p, o, o_kind, o_datatype, o_lang) and a set: repeated rows count once.
Rows with a null subject, predicate or object are left out. Preferred labels and all ties go by
code point, so results don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import stripped, squeezed
from ..sources.tables import settled
from .meeting import beside, sieve
from .ranking import model_scores

TRIPLE = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]


def triple_set(triples: DataFrame) -> DataFrame:
    return triples.select(*TRIPLE).filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def star_triples(t) -> DataFrame:
    """The star schema as a graph. t: function from table name to DataFrame; keys of its tables are unique."""

    def make(df, s, p, o, kind="uri"):
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))

    node = lambda kind, key: F.concat(F.lit(kind + "/"), F.col(key).cast("string"))
    parts = []
    for name, key, kind in (("region", "r_regionkey", "Region"), ("nation", "n_nationkey", "Nation"), ("customer", "c_custkey", "Customer"), ("supplier", "s_suppkey", "Supplier"), ("part", "p_partkey", "Part"), ("orders", "o_orderkey", "Order")):
        e = node(kind.lower(), key)
        parts.append(make(t(name), e, "type", F.lit(kind)))
        if name != "orders":
            parts.append(make(t(name), e, "label", F.col(name[0] + "_name"), "literal"))
    parts += [
        make(t("nation"), node("nation", "n_nationkey"), "partOf", node("region", "n_regionkey")),
        make(t("customer"), node("customer", "c_custkey"), "locatedIn", node("nation", "c_nationkey")),
        make(t("supplier"), node("supplier", "s_suppkey"), "locatedIn", node("nation", "s_nationkey")),
        make(t("orders"), node("order", "o_orderkey"), "placedBy", node("customer", "o_custkey")),
        # the others are told once for each key of a table; only these edges repeat, and are compared as numbers
        make(t("lineitem").select("l_orderkey", "l_partkey").distinct(), node("order", "l_orderkey"), "contains", node("part", "l_partkey")),
        make(t("lineitem").select("l_suppkey", "l_partkey").distinct(), node("supplier", "l_suppkey"), "supplies", node("part", "l_partkey")),
        make(t("part"), node("part", "p_partkey"), "brand", F.col("p_brand"), "literal"),
        make(t("customer"), node("customer", "c_custkey"), "segment", F.col("c_mktsegment"), "literal"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.filter("s IS NOT NULL AND o IS NOT NULL")


def plain_number(text: Column) -> Column:
    """A decimal number without sign of plus, zeros before it and zeros after its point; other texts as they are."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(\d)", "$1$2")
    t = F.when(F.contains(t, F.lit(".")), F.regexp_replace(F.regexp_replace(t, r"\.?0+$", ""), r"\.$", "")).otherwise(t)
    return F.when(text.rlike(r"^[+-]?\d+(\.\d*)?$"), F.when(t == "-0", "0").otherwise(t)).otherwise(text)


def number_text(c: Column) -> Column:
    """A number without exponent and without zeros at its end, to two decimals."""
    text = F.round(c, 2).cast("decimal(18,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def local_name(uri: Column) -> Column:
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def derived_label(uri: Column) -> Column:
    """A readable name from a uri: decoded local name, blanks for underscores and before Cyrillic capitals."""
    local = local_name(uri)
    decoded = F.coalesce(F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))), local)
    spaced = squeezed(F.regexp_replace(F.translate(decoded, "_", " "), "([А-Я])", " $1"))
    return F.when(local == "", uri).when(spaced == "", decoded).otherwise(spaced)


def labels(triples: DataFrame) -> DataFrame:
    """(node, label): the smallest label of each node that has one."""
    return triples.filter((F.col("p") == v.LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("node")).agg(F.min("o").alias("label"))


def types(triples: DataFrame) -> DataFrame:
    return triples.filter((F.col("p") == v.TYPE) & (F.col("o_kind") == "uri")).select(F.col("s").alias("node"), F.col("o").alias("type")).distinct()


def with_label(df: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    """The node's label, or the one derived from its uri, as ``out``."""
    own = names.select(F.col("node").alias(column), F.col("label").alias(out))
    return df.join(own, column, "left").withColumn(out, F.coalesce(out, derived_label(F.col(column))))


def node_labels(triples: DataFrame) -> DataFrame:
    """(node, label) of all uri nodes."""
    t = triple_set(triples)
    nodes = t.filter("s_kind = 'uri'").select(F.col("s").alias("node")).union(t.filter("o_kind = 'uri'").select("o")).distinct()
    return with_label(nodes, "node", labels(t), "label")


def importance(p: Column) -> Column:
    """How telling a predicate is, 1 best; the first rule that fits counts."""
    c = F.when(p.isin(v.QUANTITY_PROPERTIES), 1).when(p == v.TYPE, 2)
    for tier, names in v.IMPORTANCE.items():
        c = c.when(p.isin([v.NS + n for n in names]), tier)
    return c.when(p.isin(v.VALUE, v.UNIT), 98).when(F.startswith(p, F.lit(v.RDFS)) | F.startswith(p, F.lit(v.OWL)), 99).when(F.startswith(p, F.lit(v.NS)), 15).otherwise(20)


def quantity_values(triples: DataFrame, valueless: bool = False) -> DataFrame:
    """(qid, value_lex, unit_uri) of nodes with a literal value; the unit may be missing. valueless: also of those with a unit only."""
    value = triples.filter((F.col("p") == v.VALUE) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("qid")).agg(F.min("o").alias("value_lex"))
    unit = triples.filter(F.col("p") == v.UNIT).groupBy(F.col("s").alias("qid")).agg(F.min("o").alias("unit_uri"))
    return value.join(unit, "qid", "full" if valueless else "left")


def facts(triples: DataFrame, strict_unit: bool = False, dedupe: bool = True, missing: bool = False) -> DataFrame:
    """(fact_id, text, subject_uri, predicate_uri, predicate_importance, object_uri, object_value,
    object_datatype, object_bnode_id, object_unit_uri): one sentence for each triple of a uri subject that
    can be told, one row for each text (the first by subject, predicate and object; all without dedupe).

    Plain: subject, predicate and object; type: subject, ``е тип``, type; quantity: with value and unit
    (without unit as well, unless strict_unit; with ``MISSING`` for the value of a node without one, if missing). Numbers are told plainly (``2925``, not ``2925.0``); the
    columns keep them as they are stored.
    """
    t = triple_set(triples).filter("s_kind = 'uri'")
    names = labels(t)
    q = F.col("p").isin(v.QUANTITY_PROPERTIES)
    kind = (
        F.when(F.col("p").isin(v.SKIPPED_PREDICATES), None)
        .when(F.col("p") == v.TYPE, F.when((F.col("o_kind") == "uri") & ~F.col("o").isin(*v.SCHEMA_TYPES, v.QUANTITY_TYPE), "type"))
        .when(q & (F.col("o_kind") == "bnode"), "quantity")
        .when(q & F.contains("o", F.lit("Entity")), None)
        .when(F.col("o_kind") != "bnode", "plain")
    )
    t = t.withColumn("kind", kind).filter("kind IS NOT NULL")
    t = with_label(t, "s", names, "sl")
    # predicates are few and each in many rows: their labels are found once, not by a join of all rows
    t = t.join(with_label(t.select("p").distinct(), "p", names, "pl"), "p")
    values = quantity_values(triples.filter(F.col("p").isin(v.VALUE, v.UNIT)), valueless=missing)
    values = values.join(names.select(F.col("node").alias("unit_uri"), F.col("label").alias("ul")), "unit_uri", "left").withColumn("ul", F.coalesce("ul", derived_label(F.col("unit_uri"))))
    if strict_unit:
        values = values.filter("unit_uri IS NOT NULL")
    t = t.join(values.withColumnRenamed("qid", "o"), "o", "left")
    own = names.select(F.col("node").alias("o"), F.col("label").alias("ol"))
    told = F.when(F.col("o_datatype").isin(v.NUMBER_TYPES), plain_number(F.col("o"))).otherwise(F.col("o"))
    t = t.join(own, "o", "left").withColumn("ol", F.when(F.col("o_kind") == "literal", told).otherwise(F.coalesce("ol", derived_label(F.col("o")))))
    text = F.when(F.col("kind") == "type", F.concat_ws(" ", "sl", F.lit(v.TYPE_WORDS), "ol")).when(F.col("kind") == "quantity", F.when(F.col("value_lex").isNotNull() | F.lit(missing), F.concat_ws(" ", "sl", "pl", F.coalesce(plain_number(F.col("value_lex")), F.lit(v.MISSING)), "ul"))).otherwise(F.concat_ws(" ", "sl", "pl", "ol"))
    t = t.withColumn("text", text).filter((F.col("text").isNotNull()) & (F.col("sl") != F.col("s")) & (F.col("pl") != F.col("p")))
    if dedupe:
        first = F.row_number().over(Window.partitionBy("text").orderBy("s", "p", "o"))
        t = t.withColumn("n", first).filter("n = 1")
    return t.select(
        F.xxhash64("s", "p", "o").alias("fact_id"), "text", F.col("s").alias("subject_uri"), F.col("p").alias("predicate_uri"), importance(F.col("p")).alias("predicate_importance"),
        F.when(F.col("o_kind") == "uri", F.col("o")).alias("object_uri"), F.when(F.col("kind") == "quantity", F.col("value_lex")).when(F.col("o_kind") == "literal", F.col("o")).alias("object_value"),
        "o_datatype", F.when(F.col("o_kind") == "bnode", F.col("o")).alias("object_bnode_id"), F.col("unit_uri").alias("object_unit_uri"), F.col("ul").alias("object_unit_label"),
    ).withColumnRenamed("o_datatype", "object_datatype")


def type_names(triples: DataFrame, ignored: list[str]) -> DataFrame:
    """(node, types): the sorted labels of a node's types, with commas."""
    own = with_label(types(triples).filter(~F.col("type").isin(ignored)), "type", labels(triples), "l")
    return own.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("l")), ", ").alias("types"))


def fact_metadata(triples: DataFrame) -> DataFrame:
    """Facts with the types of subject and object."""
    t = triple_set(triples)
    f = facts(t)
    s = type_names(t, v.IGNORED_SUBJECT_TYPES).select(F.col("node").alias("subject_uri"), F.col("types").alias("subject_types"))
    o = type_names(t, v.IGNORED_OBJECT_TYPES).select(F.col("node").alias("object_uri"), F.col("types").alias("object_types"))
    return f.join(s, "subject_uri", "left").join(o, "object_uri", "left")


def tellable(text: Column) -> Column:
    """Whether a fact is worth handing on: no missing value, no generic type, not the country."""
    ends = [f"{v.TYPE_WORDS} {x}" for x in v.GENERIC_TYPES] + [v.COUNTRY_ENDING]
    bad = F.contains(text, F.lit(v.MISSING)) | (stripped(text) == "")
    for e in ends:
        bad = bad | F.endswith(text, F.lit(e))
    return text.isNotNull() & ~bad


def degrees(triples: DataFrame) -> DataFrame:
    """(node, degree): triples out of and into each uri node."""
    t = triple_set(triples)
    return t.filter("s_kind = 'uri'").select(F.col("s").alias("node")).unionAll(t.filter("o_kind = 'uri'").select("o")).groupBy("node").agg(F.count("*").alias("degree"))


def type_census(triples: DataFrame) -> DataFrame:
    return types(triple_set(triples)).groupBy(local_name(F.col("type")).alias("type_name")).agg(F.count("*").alias("n"))


def census_change(before: DataFrame, after: DataFrame, k: int = 40) -> DataFrame:
    """(type_name, before, after): the k most frequent types of two graphs, by the first one's counts."""
    a, b = type_census(before).withColumnRenamed("n", "before"), type_census(after).withColumnRenamed("n", "after")
    both = a.join(b, "type_name", "full").select("type_name", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.orderBy(F.desc("before"), F.desc("after"), "type_name").limit(k)


def snapshot_names(triples: DataFrame) -> DataFrame:
    """(what, name): classes in use, properties and typed instances of the namespace by local name."""
    t = triple_set(triples)
    own = lambda c: F.startswith(c, F.lit(v.NS))
    row = lambda df, what, c: df.select(F.lit(what).alias("what"), local_name(F.col(c)).alias("name"))
    parts = [row(t.filter((F.col("p") == v.TYPE) & own("o")), "class", "o"), row(t.filter(own("p")), "property", "p"), row(t.filter((F.col("p") == v.TYPE) & (F.col("s_kind") == "uri") & own("s")), "instance", "s")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def snapshot(triples: DataFrame) -> DataFrame:
    """(what, n): classes in use, predicates, typed instances, schema triples."""
    t = triple_set(triples)
    schema = F.col("p").isin([v.RDFS + x for x in ("subClassOf", "domain", "range")] + [v.OWL + "inverseOf"])
    one = t.agg(
        F.count_distinct(F.when((F.col("p") == v.TYPE) & F.startswith("o", F.lit(v.NS)), F.col("o"))).alias("classes"),
        F.count_distinct(F.when((F.col("o_kind") != "literal") & F.startswith("p", F.lit(v.NS)), F.col("p"))).alias("object_properties"),
        F.count_distinct(F.when((F.col("o_kind") == "literal") & F.startswith("p", F.lit(v.NS)), F.col("p"))).alias("datatype_properties"),
        F.count_distinct(F.when((F.col("p") == v.TYPE) & (F.col("s_kind") == "uri") & F.startswith("s", F.lit(v.NS)), F.col("s"))).alias("instances"),
        F.count_if(schema).alias("schema_triples"), F.count("*").alias("triples"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in one.columns])).alias("x")).select("x.*")


# Neighbourhoods

def edges(triples: DataFrame) -> DataFrame:
    """Triples that an expansion may follow: without the predicates of labels and schema."""
    return triple_set(triples).filter(~F.col("p").isin(v.SKIPPED_PREDICATES))


#: Parts into which the edges of a node are dealt where a frontier meets them, however many they are.
SALTS = 8


def hop(frontier: DataFrame, edge: DataFrame, keys: list[str]) -> DataFrame:
    """Triples out of (uri subjects only for incoming ones) and into the nodes of a frontier (*keys, node).

    A hub's edges are dealt over SALTS parts by their other end, and the frontier is repeated for each."""
    parts = frontier.withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = lambda node, other: edge.withColumn("node", F.col(node)).withColumn("part", F.pmod(F.xxhash64("p", other), F.lit(SALTS)).cast("int"))
    out = parts.join(salted("s", "o"), ["node", "part"]).select(*keys, *TRIPLE)
    into = parts.join(salted("o", "s").filter("s_kind <> 'bnode'"), ["node", "part"]).select(*keys, *TRIPLE)
    return out.unionByName(into).distinct()


def neighbourhood(seeds: DataFrame, triples: DataFrame, hops: int, keys: list[str], cap: int | None = None) -> DataFrame:
    """(*keys, hop, triple): all triples within ``hops`` of the seeds (*keys, node), each at its first hop.

    Types' objects don't lead on, nor with ``cap`` do nodes of more edges, seeds aside. One pass for each hop
    over all seeds together."""
    edge = settled(edges(triples), "edges") if hops > 1 else edges(triples)
    if cap is not None:
        ends = edge.select(F.col("s").alias("node")).union(edge.filter("s_kind <> 'bnode'").select("o"))
        small = ends.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select("node")
    seen = seeds.select(*keys, "node").distinct()
    frontier, found = seen, None
    for n in range(1, hops + 1):
        new = hop(frontier, edge, keys)
        if found is not None:
            new = new.join(found.select(*keys, "s", "p", "o", F.lit(1).alias("old")), [*keys, "s", "p", "o"], "left_anti")
        new = settled(new.withColumn("hop", F.lit(n)), "hop") if hops > 1 else new.withColumn("hop", F.lit(n))
        found = new if found is None else found.unionByName(new)
        ends = new.filter("s_kind = 'uri'").select(*keys, F.col("s").alias("node")).union(new.filter((F.col("o_kind") == "uri") & (F.col("p") != v.TYPE)).select(*keys, "o"))
        frontier = ends.distinct().join(seen, [*keys, "node"], "left_anti")
        if cap is not None:
            frontier = frontier.join(small, "node", "left_semi").select(*keys, "node")
        seen = seen.unionByName(frontier)
    return found.select(*keys, "hop", "s", "p", "o")


def beam_expansion(seeds: DataFrame, triples: DataFrame, score, hops: int = 2, limit: int = 100, beam: int = 50, frontier_size: int = 20, model=None) -> DataFrame:
    """(query_id, hop, s, p, o, text, score): per-seed expansion guided by relevance.

    seeds: (query_id, query, rank, node); a node belongs to its seed of smallest rank. A hop fetches the
    first ``limit`` triples around a seed's frontier by code point; those that are new and can be told are
    scored, the ``beam`` best of them are kept, and at most ``frontier_size`` of their nodes, in order of
    score, lead on. score: Column of (query, text); model: a model for pairs that scores in its place, in batches.

    No node can add more than its first ``limit`` triples to that, so nodes are cut to these once, before
    the queries meet them; a hub with any share of the triples costs no more than another node.
    """
    told = facts(triples).select(F.col("subject_uri").alias("s"), F.col("predicate_uri").alias("p"), F.coalesce("object_bnode_id", "object_uri", "object_value").alias("o"), "text")
    edge = edges(triples)
    around = edge.select(F.col("s").alias("node"), "s", "s_kind", "p", "o", "o_kind").union(edge.filter("s_kind <> 'bnode'").select("o", "s", "s_kind", "p", "o", "o_kind")).distinct()
    nth = F.row_number().over(Window.partitionBy("node").orderBy("s", "p", "o"))
    around = around.withColumn("n", nth).filter(F.col("n") <= limit).drop("n")
    around = settled(around.join(told, ["s", "p", "o"], "left"), "around")
    first = F.row_number().over(Window.partitionBy("query_id", "node").orderBy("rank"))
    seen = seeds.withColumn("n", first).filter("n = 1").select("query_id", "query", F.col("node").alias("seed"), "node")
    frontier, found, keys = seen, None, ["query_id", "query", "seed"]
    for n in range(1, hops + 1):
        new = frontier.join(around, "node").select(*keys, "s", "s_kind", "p", "o", "o_kind", "text").distinct()
        fetched = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("s", "p", "o"))
        new = new.withColumn("n", fetched).filter(F.col("n") <= limit)
        # a triple reached from several seeds of a query belongs to the smallest
        own = F.row_number().over(Window.partitionBy("query_id", "s", "p", "o").orderBy("seed"))
        new = new.withColumn("n", own).filter("n = 1 AND text IS NOT NULL")
        if found is not None:
            new = new.join(found.select("query_id", "s", "p", "o"), ["query_id", "s", "p", "o"], "left_anti")
        new = new.withColumn("score", score(F.col("query"), F.col("text"))) if model is None else model_scores(new, "query", "text", model)
        place = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("score"), "text"))
        new = settled(new.withColumn("n", place).filter(F.col("n") <= beam).withColumn("hop", F.lit(n)), "beam")
        found = new if found is None else found.unionByName(new)
        ends = new.filter("s_kind = 'uri'").select(*keys, F.col("s").alias("node"), "n").union(new.filter((F.col("o_kind") == "uri") & (F.col("p") != v.TYPE)).select(*keys, "o", "n"))
        ends = ends.groupBy(*keys, "node").agg(F.min("n").alias("n")).join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        best = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("n", "node"))
        frontier = ends.withColumn("k", best).filter(F.col("k") <= frontier_size).select(*keys, "node")
        seen = seen.unionByName(frontier.select("query_id", "query", "seed", "node"))
    return found.select("query_id", "hop", "s", "p", "o", "text", "score")


def adjacency(triples: DataFrame) -> DataFrame:
    """(src, dst): undirected edges between nodes of the namespace, without types."""
    t = triples.filter((F.col("p") != v.TYPE) & (F.col("o_kind") == "uri") & F.startswith("s", F.lit(v.NS)) & F.startswith("o", F.lit(v.NS)))
    pair = settled(t.select(F.least("s", "o").alias("src"), F.greatest("s", "o").alias("dst")).distinct(), "pairs")
    return pair.union(pair.filter("src <> dst").select("dst", "src"))


def _hops(seeds: DataFrame, adjacent: DataFrame, cap: int) -> DataFrame:
    """(node, hop, open) up to 2, a node at each of its hops; open: it leads on to all of its neighbours."""
    def next_to(nodes):
        near = adjacent.filter(sieve(nodes)(F.col("src")))
        return beside(near, nodes.withColumnRenamed("node", "src"), "src", ["dst"]).select(F.col("dst").alias("node")).distinct()

    seeds = seeds.select("node").distinct()
    degree = adjacent.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    one = settled(next_to(seeds).join(degree, "node", "left").select("node", F.coalesce(F.col("degree") <= cap, F.lit(False)).alias("open")), "one_hop")
    two = next_to(one.filter("open").select("node"))
    at = lambda df, hop, is_open: df.select("node", F.lit(hop).alias("hop"), is_open.alias("open"))
    return at(seeds, 0, F.lit(True)).union(at(one, 1, F.col("open"))).union(at(two, 2, F.lit(False)))


def hop_distances(seeds: DataFrame, adjacent: DataFrame, cap: int = v.HUB_DEGREE) -> DataFrame:
    """(node, hop) up to 2; the second hop only goes through nodes of at most ``cap`` neighbours."""
    return _hops(seeds, adjacent, cap).groupBy("node").agg(F.min("hop").alias("hop"))


def subgraph(triples: DataFrame, seeds: DataFrame, cap: int = v.HUB_DEGREE) -> DataFrame:
    """(s, p, o) of the part of the graph around the seeds, and the blank nodes it refers to.

    Kept: triples of schema subjects (classes, properties and whatever is used as a type); those of nodes at
    most one hop away that aren't noise, but for long descriptions of others than seeds and edges to nodes
    that weren't reached; of farther and noise nodes that were reached only the labels.

    The triples and the seeds are read several times. Triples are moved once, to their subjects, where they
    also lose repeated ones; only edges that hubs and nodes of other namespaces don't lead on by are moved
    to their objects as well.
    """
    t = triples.select("s", "s_kind", "p", "o", "o_kind").filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    is_type = F.col("p") == v.TYPE
    told = {"schema": F.lit(False), "noise": F.lit(False), "seed": F.lit(False), "hop": F.lit(None).cast("int"), "open": F.lit(False)}
    one = lambda df, c, **flags: df.select(F.col(c).alias("node"), *[x.alias(k) for k, x in (told | flags).items()])
    about = one(t.filter(is_type & F.col("o").isin(v.SCHEMA_TYPES)), "s", schema=F.lit(True)).union(one(t.filter(is_type).select("o").distinct(), "o", schema=F.lit(True)))
    about = about.union(one(t.filter(is_type & F.col("o").isin(v.NOISE_TYPES)), "s", noise=F.lit(True))).union(one(seeds, "node", seed=F.lit(True)))
    about = about.union(one(_hops(seeds, adjacency(triples), cap), "node", hop=F.col("hop"), open=F.col("open")))
    about = about.groupBy("node").agg(*[F.bool_or(c).alias(c) for c in ("schema", "noise", "seed", "open")], F.min("hop").alias("hop"))
    about = settled(about.withColumn("noise", F.col("noise") & ~F.col("seed")), "nodes")

    own = beside(t.filter("s_kind = 'uri'"), about.withColumnRenamed("node", "s"), "s", ["p", "o"])
    near = F.coalesce(F.col("hop") <= 1, F.lit(False)) & ~F.col("noise")
    long_text = F.col("p").isin(v.NS + "имаОписание", v.COMMENT) & (F.length("o") > v.DESCRIPTION_CHARS) & ~F.col("seed")
    # what a node of the namespace that leads on points to was reached
    led = F.col("open") & F.startswith("s", F.lit(v.NS)) & F.col("o_kind").isNotNull()
    unsure = ~F.col("schema") & near & (F.coalesce("o_kind", F.lit("uri")) == "uri") & F.startswith("o", F.lit(v.NS)) & ~is_type & ~led
    keep = F.col("schema") | (near & ~long_text) | (~near & (F.col("p") == v.LABEL) & (F.col("hop").isNotNull() | F.col("noise")))
    held = own.filter(keep).groupBy(*[c for c in own.columns if c == "part"], "s", "p", "o").agg(F.bool_or(~unsure).alias("sure"), F.bool_or(F.coalesce(F.col("o_kind") == "bnode", F.lit(False))).alias("blank"))
    held = settled(held.select("s", "p", "o", "sure", "blank"), "held")
    reached = about.filter("hop IS NOT NULL OR schema").select(F.col("node").alias("o"))
    unsure = held.filter("NOT sure")
    kept = held.filter("sure").union(beside(unsure, reached.filter(sieve(unsure.select("o"))(F.col("o"))), "o", ["s", "p"]).select(held.columns))

    blank = settled(kept.filter("blank").select(F.col("o").alias("s")).distinct(), "blank")
    named = F.coalesce(F.col("s_kind") == "uri", F.lit(False))
    closed = beside(t.filter(~named | sieve(blank)(F.col("s"))), blank, "s", ["p", "o"])
    closed = settled(closed.groupBy(*[c for c in closed.columns if c == "part"], "s", "p", "o").agg(F.bool_or(named).alias("named")).select("s", "p", "o", "named"), "closed")
    out = kept.select("s", "p", "o").union(closed.select("s", "p", "o"))
    # only what a uri of a blank node's name says can be in both
    return out if closed.filter("named").isEmpty() else out.distinct()


def type_expansion(retrieved: DataFrame, triples: DataFrame, limit: int = 30) -> DataFrame:
    """(query_id, s, p, o, value_lex): quantity facts of the query's most frequent quantity predicate.

    retrieved: (query_id, s, p, o), repeated rows counting again. A query without an edge to a type of the
    namespace (the most general ones aside) or without quantity predicates has none.
    """
    def most(df, column, out):
        n = df.groupBy("query_id", column).agg(F.count("*").alias("n"))
        k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), column))
        return n.withColumn("k", k).filter("k = 1").select("query_id", F.col(column).alias(out))

    kind = most(retrieved.filter((F.col("p") == v.TYPE) & F.startswith("o", F.lit(v.NS)) & ~F.col("o").isin(v.GENERAL_TYPES)), "o", "type")
    predicate = most(retrieved.filter(F.col("p").isin(v.QUANTITY_PROPERTIES)), "p", "p")
    wanted = predicate.join(kind, "query_id", "left_semi")
    t = triple_set(triples)
    facts_of = t.filter(F.col("p").isin(v.QUANTITY_PROPERTIES) & (F.col("o_kind") == "bnode") & (F.col("s_kind") == "uri")).join(quantity_values(t).filter("unit_uri IS NOT NULL").withColumnRenamed("qid", "o"), "o")
    # the first of each predicate, before the queries multiply them
    k = F.row_number().over(Window.partitionBy("p").orderBy("s", "o"))
    first = facts_of.withColumn("k", k).filter(F.col("k") <= limit)
    return wanted.join(first, "p").select("query_id", "s", "p", "o", "value_lex")
