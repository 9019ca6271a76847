"""Queries over the graph, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..operators import curation, graph, linking, quantities, ranking
from ..sources.tables import settled, table


def _t(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples")


DESCRIBES = v.NS + "имаОписание"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The described nodes as (query_id, text): label and description, the smallest of several."""
    t = _t(spark, d).filter("s IS NOT NULL AND o IS NOT NULL")
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    one = t.filter(F.col("p").isin(v.LABEL, DESCRIBES)).groupBy(F.col("s").alias("query_id")).agg(pick(v.LABEL).alias("l"), pick(DESCRIBES).alias("x"))
    return one.filter("x IS NOT NULL").select("query_id", F.concat_ws(". ", "l", "x").alias("text"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return settled(linking.linked(_texts(spark, d), linking.label_index(_t(spark, d))), "links")


def kg_star_triples(spark, d):
    return graph.star_triples(lambda name: table(spark, d, name))


def kg_top10_quantity(spark, d):
    """The ten parts of the highest price, as sentences."""
    parts = table(spark, d, "part").filter("p_retailprice IS NOT NULL")
    text = F.concat_ws(" ", "p_name", F.lit("retailPrice"), graph.number_text(F.col("p_retailprice")), F.lit("USD"))
    return parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", text.alias("text"), F.col("p_retailprice").alias("value"))


def kg_labels(spark, d):
    return graph.node_labels(_t(spark, d))


def kg_facts(spark, d):
    return graph.facts(_t(spark, d)).select("text", "subject_uri", "predicate_uri", "predicate_importance", "object_value", "object_unit_label")


def kg_fact_metadata(spark, d):
    return graph.fact_metadata(_t(spark, d)).select("text", "subject_uri", "predicate_importance", "subject_types", "object_types")


def kg_fact_prefilter(spark, d):
    return graph.facts(_t(spark, d)).filter(graph.tellable(F.col("text"))).select("text")


def kg_type_census(spark, d):
    return graph.type_census(_t(spark, d))


def kg_degree(spark, d):
    return graph.degrees(_t(spark, d))


def kg_snapshot(spark, d):
    return graph.snapshot(_t(spark, d))


def kg_nhop_1(spark, d):
    """The triples next to what each question names."""
    return graph.neighbourhood(_links(spark, d).select("query_id", "node"), _t(spark, d), 1, ["query_id"])


def kg_nhop_2(spark, d):
    """The triples within two hops of what each question names; a hub that isn't named itself doesn't lead on."""
    return graph.neighbourhood(_links(spark, d).select("query_id", "node"), _t(spark, d), 2, ["query_id"], v.HUB_DEGREE)


def kg_beam_expand(spark, d):
    seeds = _links(spark, d).join(_texts(spark, d).withColumnRenamed("text", "query"), "query_id")
    return graph.beam_expansion(seeds, _t(spark, d), ranking.stem_score)


def kg_type_expansion(spark, d):
    links = _links(spark, d).select("query_id", "node")
    return graph.type_expansion(graph.neighbourhood(links, _t(spark, d), 1, ["query_id"]), _t(spark, d))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return settled(linking.seeds(_texts(spark, d), _t(spark, d)), "seeds")


def kg_hop_distance(spark, d):
    """Hops from what any text links to, exactly or by stems."""
    return graph.hop_distances(_seeds(spark, d), graph.adjacency(_t(spark, d)))


def kg_subgraph(spark, d):
    return graph.subgraph(_t(spark, d), _seeds(spark, d))


def kg_merge_duplicate_labels(spark, d):
    """Each node that is merged away, and the one it is merged into."""
    return curation.merge_map(_t(spark, d))


def kg_ambiguous_labels(spark, d):
    return curation.label_groups(graph.triple_set(_t(spark, d))).filter("shared = 0").select("key", "members")


def kg_merged_graph(spark, d):
    return curation.merge_duplicate_labels(_t(spark, d))


def kg_type_qualified_pairs(spark, d):
    return curation.type_qualified_pairs(_t(spark, d))


def kg_bare_alias(spark, d):
    return curation.bare_aliases(_t(spark, d))


def kg_placeholder_values(spark, d):
    return curation.placeholder_values(_t(spark, d))


def kg_unit_canon(spark, d):
    return curation.canonical_units(_t(spark, d)).filter(F.col("p") == v.UNIT).groupBy(F.col("o").alias("unit_uri")).agg(F.count("*").alias("n"))


def kg_quantity_dedupe(spark, d):
    return curation.repeated_quantities(_t(spark, d))


def kg_quantity_conflicts(spark, d):
    return curation.conflicting_quantities(_t(spark, d))


def kg_label_unlabeled(spark, d):
    return curation.missing_labels(_t(spark, d))


def kg_curation_report(spark, d):
    return curation.curated(_t(spark, d))[1]


def link_entities(spark, d):
    return _links(spark, d)


def link_fuzzy_stems(spark, d):
    return linking.fuzzy_linked(_texts(spark, d), linking.label_index(_t(spark, d)))


def _read_quantities(spark: SparkSession, d: str) -> DataFrame:
    # read by the mixtures and by what they are applied to
    return settled(quantities.read_quantities(quantities.nodes(_t(spark, d)), table(spark, d, "unit_items")), "quantities")


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    read = _read_quantities(spark, d)
    return quantities.with_inferred(read, quantities.mixtures(read))


def p4_found(spark, d):
    return quantities.same_quantities(_quantities(spark, d))


def p4_quantities(spark, d):
    return _quantities(spark, d)


def p4_report(spark, d):
    return quantities.unit_report(_quantities(spark, d))


def p4_mixture(spark, d):
    """How well units are told where they are missing, by property."""
    return quantities.held_out(_read_quantities(spark, d))


def _part_triples(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a graph with namesakes: the label is name and size, for every other part with its type after it."""
    p = table(spark, d, "part").filter("p_name IS NOT NULL AND p_type IS NOT NULL")
    node, kind = F.concat(F.lit(v.NS + "part"), F.col("p_partkey").cast("string")), F.substring_index("p_type", " ", -1)
    base = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(base, F.lit(" ("), kind, F.lit(")"))).otherwise(base)
    row = lambda pred, o, k: p.select(node.alias("s"), F.lit("uri").alias("s_kind"), F.lit(pred).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    return row(v.LABEL, label, "literal").unionByName(row(v.TYPE, F.concat(F.lit(v.NS), kind), "uri"))


def part_merge_labels(spark, d):
    return curation.merge_map(_part_triples(spark, d))


def part_ambiguous_labels(spark, d):
    return curation.label_groups(_part_triples(spark, d)).filter("shared = 0").select("key", "members")


def part_type_qualified_pairs(spark, d):
    return curation.type_qualified_pairs(_part_triples(spark, d))


def part_bare_alias(spark, d):
    return curation.bare_aliases(_part_triples(spark, d))


def part_merged_graph(spark, d):
    return curation.merge_duplicate_labels(_part_triples(spark, d))


def part_type_qualified_merge(spark, d):
    return curation.merge_type_qualified(_part_triples(spark, d))


def part_aliased_graph(spark, d):
    return curation.with_aliases(_part_triples(spark, d))


def kg_census_change(spark, d):
    """The most frequent types of the graph and of the part around what texts link to."""
    t = settled(graph.triple_set(_t(spark, d)), "triples")
    kept = graph.subgraph(t, _seeds(spark, d))
    return graph.census_change(t, t.join(kept, ["s", "p", "o"], "left_semi"))


def kg_snapshot_names(spark, d):
    return graph.snapshot_names(_t(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        part_merged_graph, part_type_qualified_merge, part_aliased_graph, kg_census_change, kg_snapshot_names,
        part_merge_labels, part_ambiguous_labels, part_type_qualified_pairs, part_bare_alias,
        kg_star_triples, kg_top10_quantity, kg_labels, kg_facts, kg_fact_metadata, kg_fact_prefilter, kg_type_census, kg_degree, kg_snapshot, kg_nhop_1, kg_nhop_2, kg_beam_expand,
        kg_type_expansion, kg_hop_distance, kg_subgraph, kg_merge_duplicate_labels, kg_ambiguous_labels, kg_merged_graph, kg_type_qualified_pairs, kg_bare_alias,
        kg_placeholder_values, kg_unit_canon, kg_quantity_dedupe, kg_quantity_conflicts, kg_label_unlabeled, kg_curation_report, link_entities, link_fuzzy_stems,
        p4_found, p4_quantities, p4_report, p4_mixture,
    )
}


# The same in SQL

def _list(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _squeeze(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex({x}, '{_SP}+'), lambda w: w <> ''), ' ')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _local(x: str) -> str:
    return f"CASE WHEN contains({x}, '#') THEN split_part({x}, '#', -1) ELSE split_part({x}, '/', -1) END"


def _derived(x: str) -> str:
    name = f"url_decode({_local(x)})"
    spaced = _squeeze(f"regexp_replace(replace({name}, '_', ' '), '([А-Я])', ' \\1', 'g')")
    return f"CASE WHEN {_local(x)} = '' THEN {x} WHEN {spaced} = '' THEN {name} ELSE {spaced} END"


def _plain(x: str) -> str:
    """A decimal number told plainly."""
    t = f"regexp_replace(regexp_replace({x}, '^\\+', ''), '^(-?)0+(\\d)', '\\1\\2')"
    t = f"CASE WHEN contains({t}, '.') THEN regexp_replace(regexp_replace({t}, '\\.?0+$', ''), '\\.$', '') ELSE {t} END"
    return f"CASE WHEN regexp_full_match({x}, '[+-]?\\d+(\\.\\d*)?') THEN CASE WHEN ({t}) = '-0' THEN '0' ELSE ({t}) END ELSE {x} END"


_IMPORTANCE = (
    f"CASE WHEN p IN ({_list(v.QUANTITY_PROPERTIES)}) THEN 1 WHEN p = '{v.TYPE}' THEN 2 "
    + " ".join(f"WHEN p IN ({_list(v.NS + n for n in names)}) THEN {tier}" for tier, names in v.IMPORTANCE.items())
    + f" WHEN p IN ('{v.VALUE}', '{v.UNIT}') THEN 98 WHEN starts_with(p, '{v.RDFS}') OR starts_with(p, '{v.OWL}') THEN 99 WHEN starts_with(p, '{v.NS}') THEN 15 ELSE 20 END"
)
_T = "t AS MATERIALIZED (SELECT DISTINCT s, s_kind, p, o, o_kind, o_datatype, o_lang FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"
_NAMES = f"names AS MATERIALIZED (SELECT s AS node, min(o) AS label FROM t WHERE p = '{v.LABEL}' AND o_kind = 'literal' GROUP BY s)"
_QV = f"""qv AS MATERIALIZED (SELECT a.qid, a.value_lex, b.unit_uri FROM (SELECT s AS qid, min(o) AS value_lex FROM t WHERE p = '{v.VALUE}' AND o_kind = 'literal' GROUP BY s) a
  LEFT JOIN (SELECT s AS qid, min(o) AS unit_uri FROM t WHERE p = '{v.UNIT}' GROUP BY s) b USING (qid))"""
_FACTS = f"""{_T}, {_NAMES}, {_QV},
kinds AS (SELECT *, CASE WHEN p IN ({_list(v.SKIPPED_PREDICATES)}) THEN NULL
  WHEN p = '{v.TYPE}' THEN CASE WHEN o_kind = 'uri' AND o NOT IN ({_list([*v.SCHEMA_TYPES, v.QUANTITY_TYPE])}) THEN 'type' END
  WHEN p IN ({_list(v.QUANTITY_PROPERTIES)}) AND o_kind = 'bnode' THEN 'quantity'
  WHEN p IN ({_list(v.QUANTITY_PROPERTIES)}) AND contains(o, 'Entity') THEN NULL
  WHEN o_kind <> 'bnode' THEN 'plain' END AS kind FROM t WHERE s_kind = 'uri'),
named AS (SELECT k.*, coalesce(a.label, {_derived("k.s")}) AS sl, coalesce(b.label, {_derived("k.p")}) AS pl,
    CASE WHEN k.o_kind = 'literal' THEN CASE WHEN k.o_datatype IN ({_list(v.NUMBER_TYPES)}) THEN {_plain("k.o")} ELSE k.o END ELSE coalesce(c.label, {_derived("k.o")}) END AS ol, q.value_lex, q.unit_uri,
    CASE WHEN q.unit_uri IS NOT NULL THEN coalesce(u.label, {_derived("q.unit_uri")}) END AS ul
  FROM kinds k LEFT JOIN names a ON a.node = k.s LEFT JOIN names b ON b.node = k.p LEFT JOIN names c ON c.node = k.o LEFT JOIN qv q ON q.qid = k.o LEFT JOIN names u ON u.node = q.unit_uri WHERE k.kind IS NOT NULL),
told AS (SELECT *, CASE kind WHEN 'type' THEN sl || ' {v.TYPE_WORDS} ' || ol WHEN 'quantity' THEN CASE WHEN value_lex IS NOT NULL THEN concat_ws(' ', sl, pl, {_plain("value_lex")}, ul) END ELSE concat_ws(' ', sl, pl, ol) END AS text FROM named),
facts AS MATERIALIZED (SELECT * FROM told WHERE text IS NOT NULL AND sl <> s AND pl <> p QUALIFY row_number() OVER (PARTITION BY text ORDER BY s, p, o) = 1)"""
_TYPES = f"types AS MATERIALIZED (SELECT DISTINCT s AS node, o AS type FROM t WHERE p = '{v.TYPE}' AND o_kind = 'uri')"


def _type_names(ignored) -> str:
    return f"SELECT y.node, array_to_string(list_sort(list_distinct(list(coalesce(n.label, {_derived('y.type')})))), ', ') AS types FROM types y LEFT JOIN names n ON n.node = y.type WHERE y.type NOT IN ({_list(ignored)}) GROUP BY y.node"


_TEXTS = f"texts AS MATERIALIZED (SELECT query_id, concat_ws('. ', l, x) AS text FROM (SELECT s AS query_id, min(o) FILTER (p = '{v.LABEL}') AS l, min(o) FILTER (p = '{DESCRIBES}') AS x FROM triples WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY s) WHERE x IS NOT NULL)"
_INDEX = f"""ix AS MATERIALIZED (SELECT * FROM (SELECT lower({_strip("o")}) AS label, max(s) AS node FROM triples WHERE p = '{v.LABEL}' AND o_kind = 'literal' AND s IS NOT NULL GROUP BY 1) WHERE length(label) >= 4)"""


def _linked(k: int) -> str:
    return f"""{_TEXTS}, {_INDEX},
held AS (SELECT x.query_id, i.node, i.label FROM texts x JOIN ix i ON contains(lower(x.text), i.label)),
one AS (SELECT query_id, node, label FROM held QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY length(label) DESC, label) = 1),
links AS MATERIALIZED (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(label) DESC, label) AS INTEGER) AS rank, node, label FROM one QUALIFY rank <= {k})"""


_L = _linked(v.LINKED_ONLINE)
_EDGES = f"{_T}, edges AS MATERIALIZED (SELECT * FROM t WHERE p NOT IN ({_list(v.SKIPPED_PREDICATES)}))"
_HOP1 = """hop1 AS MATERIALIZED (SELECT query_id, e.* FROM links l JOIN edges e ON e.s = l.node UNION SELECT query_id, e.* FROM links l JOIN edges e ON e.o = l.node AND e.s_kind <> 'bnode')"""
_ADJ = f"""adj AS MATERIALIZED (SELECT s AS src, o AS dst FROM t WHERE p <> '{v.TYPE}' AND o_kind = 'uri' AND starts_with(s, '{v.NS}') AND starts_with(o, '{v.NS}')
  UNION SELECT o, s FROM t WHERE p <> '{v.TYPE}' AND o_kind = 'uri' AND starts_with(s, '{v.NS}') AND starts_with(o, '{v.NS}'))"""
def _content(x: str) -> str:
    """Words of four and more characters without signs at their ends."""
    every = f"list_filter(string_split_regex(lower({x}), '{_SP}+'), lambda w: w <> '')"
    return f"list_filter(list_transform({every}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: length(w) >= 4)"


_FUZZY = f"""st AS (SELECT label, node, list_transform({_content('label')}, lambda w: substr(w, 1, greatest(4, length(w) - 3))) AS stems FROM ix),
one_stem AS (SELECT label, node, len(stems) AS n, unnest(stems) AS stem, unnest(generate_series(0, len(stems) - 1)) AS i FROM st WHERE len(stems) > 0),
pre AS (SELECT DISTINCT query_id, substr(w, 1, CAST(k AS BIGINT)) AS stem FROM (SELECT query_id, w, unnest(generate_series(4, length(w))) AS k FROM (SELECT query_id, unnest({_content('text')}) AS w FROM texts))),
hit AS (SELECT query_id, node, label, n, count(*) AS hits, count(*) FILTER (i < 2) AS firsts FROM pre JOIN one_stem USING (stem) GROUP BY 1, 2, 3, 4),
fuzzy AS MATERIALIZED (SELECT query_id, node, label FROM hit WHERE hits = n OR (n >= 3 AND (hits >= n - 1 OR firsts = 2)))"""
_DIST = f"""{_T}, {_linked(v.LINKED_PER_QUESTION)}, {_FUZZY}, {_ADJ}, seeds AS MATERIALIZED (SELECT node FROM links UNION SELECT node FROM fuzzy), one_hop AS MATERIALIZED (SELECT DISTINCT dst AS node FROM seeds JOIN adj ON src = node),
two_hop AS (SELECT DISTINCT dst AS node FROM one_hop JOIN adj ON src = node WHERE node IN (SELECT src FROM adj GROUP BY src HAVING count(*) <= {v.HUB_DEGREE})),
dist AS MATERIALIZED (SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT node, 0 AS hop FROM seeds UNION ALL SELECT node, 1 FROM one_hop UNION ALL SELECT node, 2 FROM two_hop) GROUP BY node)"""
_KEYS = f"keys AS MATERIALIZED (SELECT DISTINCT lower({_strip('o')}) AS key, s AS node FROM t WHERE p = '{v.LABEL}' AND o_kind = 'literal' AND lower({_strip('o')}) <> '')"
_GROUPS = f"""{_T}, {_TYPES}, {_KEYS}, groups AS MATERIALIZED (SELECT key, count(*) AS members FROM keys GROUP BY key HAVING count(*) > 1),
shared AS MATERIALIZED (SELECT key, count(*) AS shared FROM (SELECT k.key, y.type FROM keys k JOIN groups g USING (key) JOIN types y USING (node) WHERE y.type NOT IN ({_list(v.SCHEMA_TYPES)}) GROUP BY k.key, g.members, y.type HAVING count(*) = g.members) GROUP BY key)"""
_MERGE = f"""{_GROUPS}, pairs AS MATERIALIZED (SELECT DISTINCT a.node AS a, b.node AS b FROM keys a JOIN keys b USING (key) JOIN shared USING (key)),
reach(node, other) AS (SELECT a, b FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
ends AS (SELECT s AS node, s_kind AS kind FROM t UNION ALL SELECT o, o_kind FROM t WHERE o_kind <> 'literal'),
deg AS (SELECT node, count(*) AS degree, max(CAST(kind = 'uri' AS INTEGER)) AS is_uri FROM ends GROUP BY node),
best AS (SELECT root, first(node ORDER BY is_uri DESC, degree DESC, node) AS kept FROM roots JOIN deg USING (node) GROUP BY root),
map AS MATERIALIZED (SELECT node, kept FROM roots JOIN best USING (root) WHERE node <> kept)"""
_TW = "tw AS MATERIALIZED (SELECT DISTINCT lower(l) AS word FROM (SELECT split_part(split_part(type, '#', -1), '/', -1) AS l FROM types) WHERE regexp_full_match(l, '\\p{L}+'))"
_Q = r"^(.+?)\s*\(([^()]+)\)\s*$"
_OWN = f"own AS MATERIALIZED (SELECT DISTINCT s AS node, {_strip('o')} AS text FROM t WHERE p = '{v.LABEL}' AND o_kind = 'literal')"
_PAREN = f"paren AS (SELECT node, text, {_strip(f'''regexp_extract(text, '{_Q}', 1)''')} AS base FROM own WHERE regexp_matches(text, '{_Q}') AND lower({_strip(f'''regexp_extract(text, '{_Q}', 2)''')}) IN (SELECT word FROM tw))"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_QL = f"{_T}, {_QV}, ql AS MATERIALIZED (SELECT t.s, t.p, t.o AS qid, q.value_lex, q.unit_uri FROM t JOIN qv q ON q.qid = t.o WHERE t.o_kind = 'bnode')"


def _star() -> str:
    parts = []
    for name, key, kind in (("region", "r_regionkey", "Region"), ("nation", "n_nationkey", "Nation"), ("customer", "c_custkey", "Customer"), ("supplier", "s_suppkey", "Supplier"), ("part", "p_partkey", "Part"), ("orders", "o_orderkey", "Order")):
        parts.append(f"SELECT '{kind.lower()}/' || {key} AS s, 'type' AS p, '{kind}' AS o, 'uri' AS o_kind FROM {name}")
        if name != "orders":
            parts.append(f"SELECT '{kind.lower()}/' || {key}, 'label', {name[0]}_name, 'literal' FROM {name}")
    parts += [
        "SELECT 'nation/' || n_nationkey, 'partOf', 'region/' || n_regionkey, 'uri' FROM nation",
        "SELECT 'customer/' || c_custkey, 'locatedIn', 'nation/' || c_nationkey, 'uri' FROM customer",
        "SELECT 'supplier/' || s_suppkey, 'locatedIn', 'nation/' || s_nationkey, 'uri' FROM supplier",
        "SELECT 'order/' || o_orderkey, 'placedBy', 'customer/' || o_custkey, 'uri' FROM orders",
        "SELECT 'order/' || l_orderkey, 'contains', 'part/' || l_partkey, 'uri' FROM lineitem",
        "SELECT 'supplier/' || l_suppkey, 'supplies', 'part/' || l_partkey, 'uri' FROM lineitem",
        "SELECT 'part/' || p_partkey, 'brand', p_brand, 'literal' FROM part",
        "SELECT 'customer/' || c_custkey, 'segment', c_mktsegment, 'literal' FROM customer",
    ]
    return "SELECT * FROM (" + " UNION ".join(parts) + ") WHERE s IS NOT NULL AND o IS NOT NULL"


_BAD = " OR ".join([f"contains(text, '{v.MISSING}')", f"{_strip('text')} = ''"] + [f"ends_with(text, '{e}')" for e in [f"{v.TYPE_WORDS} {x}" for x in v.GENERIC_TYPES] + [v.COUNTRY_ENDING]])


def keywords_sql(x: str) -> str:
    every = f"list_filter(string_split_regex(lower({x}), '{_SP}+'), lambda w: w <> '')"
    return f"list_distinct(list_filter({every}, lambda w: length(w) > 2 AND w NOT IN ({_list(v.STOP_WORDS)})))"


def lexical_sql(q: str, t: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(list_filter({keywords_sql(q)}, lambda w: contains(lower({t}), w)), lambda w: 2 * length(w))), 0) AS INTEGER)"


def stem_sql(q: str, t: str) -> str:
    stems = lambda x: f"list_distinct(list_transform({keywords_sql(x)}, lambda w: substr(w, 1, greatest(4, length(w) - 3))))"
    return f"CAST({lexical_sql(q, t)} + coalesce(list_sum(list_transform(list_intersect({stems(q)}, {stems(t)}), lambda w: length(w))), 0) AS INTEGER)"


def _beam(n: int, frontier: str) -> str:
    """One hop of the beam from a frontier (query_id, query, seed, node)."""
    old = f" WHERE NOT EXISTS (SELECT 1 FROM b{n - 1} z WHERE z.query_id = w.query_id AND z.s = w.s AND z.p = w.p AND z.o = w.o)" if n > 1 else ""
    return f"""n{n} AS (SELECT f.query_id, f.query, f.seed, e.s, e.s_kind, e.p, e.o, e.o_kind FROM {frontier} f JOIN edges e ON e.s = f.node UNION SELECT f.query_id, f.query, f.seed, e.s, e.s_kind, e.p, e.o, e.o_kind FROM {frontier} f JOIN edges e ON e.o = f.node AND e.s_kind <> 'bnode'),
l{n} AS (SELECT * FROM n{n} QUALIFY row_number() OVER (PARTITION BY query_id, seed ORDER BY s, p, o) <= 100),
w{n} AS (SELECT * FROM l{n} QUALIFY row_number() OVER (PARTITION BY query_id, s, p, o ORDER BY seed) = 1),
x{n} AS (SELECT w.*, g.text, {stem_sql("w.query", "g.text")} AS score FROM w{n} w JOIN told_as g ON g.s = w.s AND g.p = w.p AND g.obj = w.o{old}),
b{n} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY score DESC, text) AS n FROM x{n} QUALIFY n <= 50)"""


ORACLE = {
    "kg_star_triples": _star(),
    "kg_top10_quantity": r"SELECT p_partkey, concat_ws(' ', p_name, 'retailPrice', regexp_replace(regexp_replace(CAST(CAST(round(p_retailprice, 2) AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\.$', ''), 'USD') AS text, p_retailprice AS value FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
    "kg_labels": f"WITH {_T}, {_NAMES} SELECT n.node, coalesce(a.label, {_derived('n.node')}) AS label FROM (SELECT s AS node FROM t WHERE s_kind = 'uri' UNION SELECT o FROM t WHERE o_kind = 'uri') n LEFT JOIN names a USING (node)",
    "kg_facts": f"WITH {_FACTS} SELECT text, s AS subject_uri, p AS predicate_uri, {_IMPORTANCE} AS predicate_importance, CASE WHEN kind = 'quantity' THEN value_lex WHEN o_kind = 'literal' THEN o END AS object_value, ul AS object_unit_label FROM facts",
    "kg_fact_metadata": f"WITH {_FACTS}, {_TYPES}, st AS ({_type_names(v.IGNORED_SUBJECT_TYPES)}), ot AS ({_type_names(v.IGNORED_OBJECT_TYPES)}) SELECT text, s AS subject_uri, {_IMPORTANCE} AS predicate_importance, st.types AS subject_types, ot.types AS object_types FROM facts f LEFT JOIN st ON st.node = f.s LEFT JOIN ot ON ot.node = f.o AND f.o_kind = 'uri'",
    "kg_fact_prefilter": f"WITH {_FACTS} SELECT text FROM facts WHERE NOT ({_BAD})",
    "kg_type_census": f"WITH {_T}, {_TYPES} SELECT {_local('type')} AS type_name, count(*) AS n FROM types GROUP BY 1",
    "kg_degree": f"WITH {_T} SELECT node, count(*) AS degree FROM (SELECT s AS node FROM t WHERE s_kind = 'uri' UNION ALL SELECT o FROM t WHERE o_kind = 'uri') GROUP BY node",
    "kg_snapshot": f"""WITH {_T} SELECT unnest(['classes', 'object_properties', 'datatype_properties', 'instances', 'schema_triples', 'triples']) AS what, unnest([
  count(DISTINCT o) FILTER (p = '{v.TYPE}' AND starts_with(o, '{v.NS}')), count(DISTINCT p) FILTER (o_kind <> 'literal' AND starts_with(p, '{v.NS}')),
  count(DISTINCT p) FILTER (o_kind = 'literal' AND starts_with(p, '{v.NS}')), count(DISTINCT s) FILTER (p = '{v.TYPE}' AND s_kind = 'uri' AND starts_with(s, '{v.NS}')),
  count(*) FILTER (p IN ({_list([v.RDFS + x for x in ("subClassOf", "domain", "range")] + [v.OWL + "inverseOf"])})), count(*)]) AS n FROM t""",
    "kg_nhop_1": f"WITH {_EDGES}, {_L}, {_HOP1} SELECT DISTINCT query_id, 1 AS hop, s, p, o FROM hop1",
    "kg_nhop_2": f"""WITH {_EDGES}, {_L}, seeds AS MATERIALIZED (SELECT DISTINCT query_id, node FROM links),
h1 AS MATERIALIZED (SELECT query_id, e.* FROM seeds JOIN edges e ON e.s = node UNION SELECT query_id, e.* FROM seeds JOIN edges e ON e.o = node AND e.s_kind <> 'bnode'),
small AS MATERIALIZED (SELECT node FROM (SELECT s AS node FROM edges UNION ALL SELECT o FROM edges WHERE s_kind <> 'bnode') GROUP BY 1 HAVING count(*) <= {v.HUB_DEGREE}),
f1 AS MATERIALIZED (SELECT * FROM (SELECT query_id, s AS node FROM h1 WHERE s_kind = 'uri' UNION SELECT query_id, o FROM h1 WHERE o_kind = 'uri' AND p <> '{v.TYPE}' EXCEPT SELECT query_id, node FROM seeds) WHERE node IN (SELECT node FROM small)),
h2 AS (SELECT query_id, e.* FROM f1 JOIN edges e ON e.s = node UNION SELECT query_id, e.* FROM f1 JOIN edges e ON e.o = node AND e.s_kind <> 'bnode')
SELECT query_id, 1 AS hop, s, p, o FROM h1 UNION ALL SELECT query_id, 2, s, p, o FROM h2 z WHERE NOT EXISTS (SELECT 1 FROM h1 y WHERE y.query_id = z.query_id AND y.s = z.s AND y.p = z.p AND y.o = z.o)""",
    "kg_beam_expand": f"""WITH {_FACTS}, edges AS MATERIALIZED (SELECT * FROM t WHERE p NOT IN ({_list(v.SKIPPED_PREDICATES)})), {_L},
told_as AS MATERIALIZED (SELECT s, p, CASE WHEN o_kind IN ('bnode', 'uri') THEN o WHEN kind = 'quantity' THEN value_lex ELSE o END AS obj, text FROM facts),
start AS MATERIALIZED (SELECT l.query_id, x.text AS query, l.node AS seed, l.node FROM links l JOIN texts x USING (query_id) QUALIFY row_number() OVER (PARTITION BY l.query_id, l.node ORDER BY l.rank) = 1),
{_beam(1, "start")},
e1 AS (SELECT query_id, query, seed, node, min(n) AS n FROM (SELECT query_id, query, seed, s AS node, n FROM b1 WHERE s_kind = 'uri' UNION ALL SELECT query_id, query, seed, o, n FROM b1 WHERE o_kind = 'uri' AND p <> '{v.TYPE}') WHERE (query_id, node) NOT IN (SELECT (query_id, node) FROM start) GROUP BY ALL),
f1 AS MATERIALIZED (SELECT query_id, query, seed, node FROM e1 QUALIFY row_number() OVER (PARTITION BY query_id, seed ORDER BY n, node) <= 20),
{_beam(2, "f1")}
SELECT query_id, 1 AS hop, s, p, o, text, score FROM b1 UNION ALL SELECT query_id, 2, s, p, o, text, score FROM b2""",
    "kg_type_expansion": f"""WITH {_EDGES}, {_QV}, {_L}, {_HOP1}, got AS MATERIALIZED (SELECT DISTINCT query_id, s, p, o FROM hop1),
k AS (SELECT DISTINCT query_id FROM got WHERE p = '{v.TYPE}' AND starts_with(o, '{v.NS}') AND o NOT IN ({_list(v.GENERAL_TYPES)})),
m AS (SELECT query_id, p FROM (SELECT query_id, p, count(*) AS n FROM got WHERE p IN ({_list(v.QUANTITY_PROPERTIES)}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, p) = 1),
f AS (SELECT t.s, t.p, t.o, q.value_lex FROM t JOIN qv q ON q.qid = t.o WHERE t.p IN ({_list(v.QUANTITY_PROPERTIES)}) AND t.o_kind = 'bnode' AND t.s_kind = 'uri' AND q.unit_uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t.p ORDER BY t.s, t.o) <= 30)
SELECT query_id, f.s, f.p, f.o, f.value_lex FROM m JOIN k USING (query_id) JOIN f USING (p)""",
    "kg_hop_distance": f"WITH {_DIST} SELECT node, hop FROM dist",
    "kg_subgraph": f"""WITH {_DIST},
schema_nodes AS MATERIALIZED (SELECT s AS node FROM t WHERE p = '{v.TYPE}' AND o IN ({_list(v.SCHEMA_TYPES)}) UNION SELECT o FROM t WHERE p = '{v.TYPE}'),
noise AS MATERIALIZED (SELECT s AS node FROM t WHERE p = '{v.TYPE}' AND o IN ({_list(v.NOISE_TYPES)}) EXCEPT SELECT node FROM seeds),
own AS (SELECT t.s, t.p, t.o, t.o_kind, sc.node IS NOT NULL AS is_schema, coalesce(di.hop <= 1, false) AND no.node IS NULL AS near, di.hop IS NOT NULL OR no.node IS NOT NULL AS known, se.node IS NOT NULL AS seed, od.hop IS NULL AS o_far, os.node IS NOT NULL AS o_schema
  FROM t LEFT JOIN schema_nodes sc ON sc.node = t.s LEFT JOIN dist di ON di.node = t.s LEFT JOIN noise no ON no.node = t.s LEFT JOIN seeds se ON se.node = t.s LEFT JOIN dist od ON od.node = t.o LEFT JOIN schema_nodes os ON os.node = t.o WHERE t.s_kind = 'uri'),
kept AS MATERIALIZED (SELECT s, p, o, o_kind FROM own WHERE is_schema
  OR (near AND NOT (p IN ('{v.NS}имаОписание', '{v.COMMENT}') AND length(o) > {v.DESCRIPTION_CHARS} AND NOT seed) AND NOT (o_kind = 'uri' AND starts_with(o, '{v.NS}') AND o_far AND NOT o_schema AND p <> '{v.TYPE}'))
  OR (NOT near AND p = '{v.LABEL}' AND known))
SELECT s, p, o FROM kept UNION SELECT t.s, t.p, t.o FROM t WHERE t.s IN (SELECT o FROM kept WHERE o_kind = 'bnode')""",
    "kg_snapshot_names": f"WITH {_T} SELECT 'class' AS what, {_local('o')} AS name FROM t WHERE p = '{v.TYPE}' AND starts_with(o, '{v.NS}') UNION SELECT 'property', {_local('p')} FROM t WHERE starts_with(p, '{v.NS}') UNION SELECT 'instance', {_local('s')} FROM t WHERE p = '{v.TYPE}' AND s_kind = 'uri' AND starts_with(s, '{v.NS}')",
    "kg_merge_duplicate_labels": f"WITH RECURSIVE {_MERGE} SELECT node, kept FROM map",
    "kg_ambiguous_labels": f"WITH {_GROUPS} SELECT key, members FROM groups WHERE key NOT IN (SELECT key FROM shared)",
    "kg_merged_graph": f"""WITH RECURSIVE {_MERGE}, r AS (SELECT coalesce(a.kept, t.s) AS s, t.p, CASE WHEN t.o_kind = 'literal' THEN t.o ELSE coalesce(b.kept, t.o) END AS o, t.o_kind AS k, t.o_datatype, t.o_lang FROM t LEFT JOIN map a ON a.node = t.s LEFT JOIN map b ON b.node = t.o)
SELECT DISTINCT s, CASE WHEN starts_with(s, '_:') THEN 'bnode' ELSE 'uri' END AS s_kind, p, o, CASE WHEN k = 'literal' THEN k WHEN starts_with(o, '_:') THEN 'bnode' ELSE 'uri' END AS o_kind, o_datatype, o_lang FROM r""",
    "kg_type_qualified_pairs": f"""WITH {_T}, {_TYPES}, {_KEYS}, {_TW}, {_OWN}, {_PAREN},
spaced AS (SELECT node, text, substr(text, 1, length(text) - length(split_part(text, ' ', -1)) - 1) AS base FROM own WHERE contains(text, ' ') AND lower(split_part(text, ' ', -1)) IN (SELECT word FROM tw)),
bases AS (SELECT DISTINCT node, lower(base) AS key FROM (SELECT * FROM paren UNION ALL SELECT * FROM spaced) WHERE base <> '' AND lower(base) <> lower(text)),
pair AS (SELECT DISTINCT b.node, k.node AS other FROM bases b JOIN keys k USING (key) WHERE b.node <> k.node)
SELECT DISTINCT least(p.node, p.other) AS a, greatest(p.node, p.other) AS b FROM pair p JOIN types x ON x.node = p.node JOIN types y ON y.node = p.other AND y.type = x.type WHERE x.type NOT IN ({_list(v.SCHEMA_TYPES)})""",
    "kg_bare_alias": f"""WITH {_T}, {_TYPES}, {_KEYS}, {_TW}, {_OWN}, {_PAREN}
SELECT DISTINCT p.node, p.text, p.base AS alias FROM paren p WHERE base <> '' AND lower(base) <> lower(text) AND node IN (SELECT node FROM own GROUP BY node HAVING count(DISTINCT text) = 1) AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.key = lower(p.base) AND k.node <> p.node)""",
    "kg_placeholder_values": f"WITH {_T} SELECT s AS qid, o AS value_lex FROM t WHERE p = '{v.VALUE}' AND o_kind = 'literal' AND NOT regexp_matches(o, '{_NUMBER}')",
    "kg_unit_canon": f"WITH {_T} SELECT o AS unit_uri, count(*) AS n FROM (SELECT DISTINCT s, s_kind, p, CASE o WHEN '{v.NS}‰' THEN '{v.NS}Промил' ELSE o END AS o, o_kind, o_datatype, o_lang FROM t WHERE p = '{v.UNIT}') GROUP BY 1",
    "kg_quantity_dedupe": f"WITH {_QL} SELECT DISTINCT qid, kept FROM (SELECT qid, min(qid) OVER (PARTITION BY s, p, value_lex, unit_uri) AS kept FROM ql) WHERE qid <> kept",
    "kg_quantity_conflicts": f"WITH {_QL} SELECT s, p, list_sort(list_distinct(list(concat_ws(' ', value_lex, unit_uri)))) AS readings FROM ql GROUP BY s, p HAVING len(readings) > 1",
    "kg_label_unlabeled": f"WITH {_T} SELECT node, {_derived('node')} AS label FROM (SELECT DISTINCT s AS node FROM t WHERE p = '{v.TYPE}' AND s_kind = 'uri' AND starts_with(s, '{v.NS}') AND s NOT IN (SELECT s FROM t WHERE p = '{v.LABEL}'))",
    "link_entities": f"WITH {_L} SELECT query_id, rank, node, label FROM links",
    "link_fuzzy_stems": f"WITH {_TEXTS}, {_INDEX}, {_FUZZY} SELECT query_id, node, label FROM fuzzy",
}

_SUB = ORACLE["kg_subgraph"].removeprefix("WITH ").replace("SELECT s, p, o FROM kept UNION SELECT t.s", ", sub AS MATERIALIZED (SELECT s, p, o FROM kept UNION SELECT t.s") + ")"
ORACLE["kg_census_change"] = f"""WITH {_SUB.replace(chr(10) + ", sub", ", sub")}, x AS (SELECT DISTINCT t.s AS node, t.o AS type, EXISTS (SELECT 1 FROM sub WHERE sub.s = t.s AND sub.p = t.p AND sub.o = t.o) AS stays FROM t WHERE p = '{v.TYPE}' AND o_kind = 'uri')
SELECT {_local('type')} AS type_name, count(*) AS before, count(*) FILTER (stays) AS after FROM x GROUP BY 1 ORDER BY before DESC, after DESC, type_name LIMIT 40"""


def _rewritten(source: str, mapping: str) -> str:
    """The triples of a table with every mapped node replaced."""
    return f"""SELECT DISTINCT s, CASE WHEN starts_with(s, '_:') THEN 'bnode' ELSE 'uri' END AS s_kind, p, o, CASE WHEN k = 'literal' THEN k WHEN starts_with(o, '_:') THEN 'bnode' ELSE 'uri' END AS o_kind, o_datatype, o_lang
  FROM (SELECT coalesce(a.kept, z.s) AS s, z.p, CASE WHEN z.o_kind = 'literal' THEN z.o ELSE coalesce(b.kept, z.o) END AS o, z.o_kind AS k, z.o_datatype, z.o_lang FROM {source} z LEFT JOIN {mapping} a ON a.node = z.s LEFT JOIN {mapping} b ON b.node = z.o)"""


_TQ = ORACLE["kg_type_qualified_pairs"].removeprefix("WITH ")
_TQ_HEAD, _, _TQ_PAIRS = _TQ.rpartition("SELECT DISTINCT least(p.node")
ORACLE["kg_type_qualified_merge"] = f"""WITH RECURSIVE {_TQ_HEAD.rstrip()}, tq AS MATERIALIZED (SELECT DISTINCT least(p.node{_TQ_PAIRS}), both_ways AS MATERIALIZED (SELECT a, b FROM tq UNION SELECT b, a FROM tq),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, p.b FROM reach r JOIN both_ways p ON r.other = p.a),
roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node),
ends AS (SELECT s AS node, s_kind AS kind FROM t UNION ALL SELECT o, o_kind FROM t WHERE o_kind <> 'literal'),
deg AS (SELECT node, count(*) AS degree, max(CAST(kind = 'uri' AS INTEGER)) AS is_uri FROM ends GROUP BY node),
best AS (SELECT root, first(node ORDER BY is_uri DESC, degree DESC, node) AS kept FROM roots JOIN deg USING (node) GROUP BY root),
map AS MATERIALIZED (SELECT node, kept FROM roots JOIN best USING (root) WHERE node <> kept)
{_rewritten("t", "map")}"""
ORACLE["kg_aliased_graph"] = ORACLE["kg_bare_alias"].replace("SELECT DISTINCT p.node, p.text", "SELECT * FROM t UNION SELECT node, 'uri', '" + v.LABEL + "', alias, 'literal', NULL, 'bg' FROM (SELECT DISTINCT p.node, p.text", 1) + ")"
ORACLE["kg_curation_report"] = f"""WITH RECURSIVE {_MERGE}, t1 AS MATERIALIZED ({_rewritten("t", "map")}),
bad AS MATERIALIZED (SELECT s AS qid, o FROM t1 WHERE p = '{v.VALUE}' AND o_kind = 'literal' AND NOT regexp_matches(o, '{_NUMBER}')),
t2 AS MATERIALIZED (SELECT * FROM t1 WHERE s NOT IN (SELECT qid FROM bad) AND o NOT IN (SELECT qid FROM bad)),
t3 AS MATERIALIZED (SELECT DISTINCT s, s_kind, p, CASE WHEN p = '{v.UNIT}' AND o = '{v.NS}‰' THEN '{v.NS}Промил' ELSE o END AS o, o_kind, o_datatype, o_lang FROM t2),
q3 AS MATERIALIZED (SELECT z.s, z.p, z.o AS qid, a.value_lex, b.unit_uri FROM t3 z JOIN (SELECT s AS qid, min(o) AS value_lex FROM t3 WHERE p = '{v.VALUE}' AND o_kind = 'literal' GROUP BY s) a ON a.qid = z.o LEFT JOIN (SELECT s AS qid, min(o) AS unit_uri FROM t3 WHERE p = '{v.UNIT}' GROUP BY s) b ON b.qid = z.o WHERE z.o_kind = 'bnode'),
again AS MATERIALIZED (SELECT DISTINCT qid, kept FROM (SELECT qid, min(qid) OVER (PARTITION BY s, p, value_lex, unit_uri) AS kept FROM q3) WHERE qid <> kept),
t4 AS MATERIALIZED (SELECT * FROM t3 WHERE s NOT IN (SELECT qid FROM again) AND o NOT IN (SELECT qid FROM again)),
q4 AS (SELECT * FROM q3 WHERE qid NOT IN (SELECT qid FROM again) AND s NOT IN (SELECT qid FROM again))
SELECT 'merged_labels' AS pass, count(*) AS changed FROM map UNION ALL SELECT 'ambiguous_labels', count(*) FROM groups WHERE key NOT IN (SELECT key FROM shared)
UNION ALL SELECT 'placeholder_values', count(*) FROM bad UNION ALL SELECT 'unit_aliases', count(*) FROM t2 WHERE p = '{v.UNIT}' AND o = '{v.NS}‰'
UNION ALL SELECT 'repeated_quantities', count(*) FROM again UNION ALL SELECT 'conflicting_quantities', count(*) FROM (SELECT s, p FROM q4 GROUP BY s, p HAVING count(DISTINCT concat_ws(' ', value_lex, unit_uri)) > 1)
UNION ALL SELECT 'labels_added', count(*) FROM (SELECT DISTINCT s FROM t4 WHERE p = '{v.TYPE}' AND s_kind = 'uri' AND starts_with(s, '{v.NS}') AND s NOT IN (SELECT s FROM t4 WHERE p = '{v.LABEL}'))"""

# the same SQL over the parts, which stand in for the triples
_PARTS = f"""triples AS (SELECT s, 'uri' AS s_kind, p, o, o_kind, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM (
  SELECT '{v.NS}part' || p_partkey AS s, '{v.LABEL}' AS p, p_name || ' ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' (' || split_part(p_type, ' ', -1) || ')' ELSE '' END AS o, 'literal' AS o_kind FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL
  UNION ALL SELECT '{v.NS}part' || p_partkey, '{v.TYPE}', '{v.NS}' || split_part(p_type, ' ', -1), 'uri' FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL))"""
for _own, _of in (("part_merge_labels", "kg_merge_duplicate_labels"), ("part_ambiguous_labels", "kg_ambiguous_labels"), ("part_type_qualified_pairs", "kg_type_qualified_pairs"), ("part_bare_alias", "kg_bare_alias"), ("part_merged_graph", "kg_merged_graph"), ("part_type_qualified_merge", "kg_type_qualified_merge"), ("part_aliased_graph", "kg_aliased_graph")):
    _head, _, _rest = ORACLE[_of].partition(" t AS MATERIALIZED")
    ORACLE[_own] = f"{_head} {_PARTS}, t AS MATERIALIZED{_rest}"
for _of in ("kg_type_qualified_merge", "kg_aliased_graph"):  # only asked of the parts, which have such names
    del ORACLE[_of]
