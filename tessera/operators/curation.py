"""Curation of a graph: merging duplicates, aliases, units, quantities, missing labels.

Every operator takes and gives triples; what it changed comes as a report. All choices are by total
order, so the result doesn't depend on that of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import stripped
from ..sources.tables import settled
from . import graph as g

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def label_keys(triples: DataFrame) -> DataFrame:
    """(key, node): labels in lower case, without blanks at either end."""
    t = triples.filter((F.col("p") == v.LABEL) & (F.col("o_kind") == "literal"))
    return t.select(F.lower(stripped(F.col("o"))).alias("key"), F.col("s").alias("node")).filter("key <> ''").distinct()


def label_groups(triples: DataFrame) -> DataFrame:
    """(key, members, shared): labels of several subjects, and how many types all members have."""
    own = label_keys(triples)
    sizes = own.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    member = own.join(sizes, "key")
    types = g.types(triples).filter(~F.col("type").isin(v.SCHEMA_TYPES))
    common = member.join(types, "node").groupBy("key", "members", "type").agg(F.count("*").alias("n")).filter("n = members").groupBy("key").agg(F.count("*").alias("shared"))
    return sizes.join(common, "key", "left").select("key", "members", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of (a, b).

    Every node takes the smallest root among its neighbours and then that root's own root, which halves
    the way left in each round, until nothing changes. Each round is written to the shared folder, so the
    plan doesn't grow and a lost executor costs one round at most.
    """
    both = settled(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    root = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        offered = both.join(root, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        near = settled(root.join(offered, "node", "left").select("node", F.least("root", "offer").alias("near"), F.col("root").alias("was")), "near")
        above = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = settled(near.join(above, "near", "left").select("node", F.least("near", "far").alias("root"), "was"), "roots")
        root = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return root


def merge_map(triples: DataFrame) -> DataFrame:
    """(node, kept): members of label groups with a shared type, and the one that each is merged into:
    a uri before a blank node, then the highest degree, then the smallest."""
    t = g.triple_set(triples)
    member = label_keys(t).join(label_groups(t).filter("shared > 0"), "key")
    least = member.groupBy("key").agg(F.min("node").alias("b"))
    return kept_of(member.join(least, "key").select(F.col("node").alias("a"), "b"), t)


def kept_of(pairs: DataFrame, t: DataFrame) -> DataFrame:
    """(node, kept) of the components of pairs (a, b): a uri before a blank node, then the highest degree,
    then the smallest."""
    root = components(pairs)
    ends = t.select(F.col("s").alias("node"), F.col("s_kind").alias("kind")).unionAll(t.filter("o_kind <> 'literal'").select("o", "o_kind"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"), F.max((F.col("kind") == "uri").cast("int")).alias("is_uri"))
    best = root.join(degree, "node").groupBy("root").agg(F.min_by("node", F.struct(-F.col("is_uri"), -F.col("degree"), "node")).alias("kept"))
    return root.join(best, "root").filter("node <> kept").select("node", "kept")


def rewritten(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """The triples with every mapped node replaced, as a set."""
    m = mapping.select("node", "kept")
    t = g.triple_set(triples)
    t = t.join(m.select(F.col("node").alias("s"), F.col("kept").alias("ks")), "s", "left").withColumn("s", F.coalesce("ks", "s"))
    # literals keep their text even where it equals a node's name
    t = t.withColumn("on", F.when(F.col("o_kind") != "literal", F.col("o"))).join(m.select(F.col("node").alias("on"), F.col("kept").alias("ko")), "on", "left").withColumn("o", F.coalesce("ko", "o"))
    kind = lambda c, was: F.when(F.startswith(c, F.lit("_:")), "bnode").otherwise(was)
    return t.select("s", kind(F.col("s"), F.lit("uri")).alias("s_kind"), "p", "o", F.when(F.col("o_kind") == "literal", F.col("o_kind")).otherwise(kind(F.col("o"), F.lit("uri"))).alias("o_kind"), "o_datatype", "o_lang").distinct()


def merge_duplicate_labels(triples: DataFrame) -> DataFrame:
    return rewritten(triples, merge_map(triples))


_QUALIFIED = r"^(.+?)\s*\(([^()]+)\)\s*$"


def type_words(triples: DataFrame) -> DataFrame:
    """(word): names of types made of letters, in lower case."""
    local = F.substring_index(F.substring_index("type", "#", -1), "/", -1)
    return g.types(triples).select(F.lower(local).alias("word"), local.alias("l")).filter(F.col("l").rlike(r"^\p{L}+$")).select("word").distinct()


def _bases(triples: DataFrame, spaced: bool) -> DataFrame:
    """(node, text, base): labels ``X (type)``, and ``X type`` where spaced, with their X."""
    own = triples.filter((F.col("p") == v.LABEL) & (F.col("o_kind") == "literal")).select(F.col("s").alias("node"), stripped(F.col("o")).alias("text")).distinct()
    word = F.lower(stripped(F.regexp_extract("text", _QUALIFIED, 2)))
    found = own.withColumn("word", F.when(F.col("text").rlike(_QUALIFIED), word)).join(type_words(triples), "word", "left_semi").select("node", "text", stripped(F.regexp_extract("text", _QUALIFIED, 1)).alias("base"))
    if spaced:
        last = F.lower(F.substring_index("text", " ", -1))
        rest = own.filter(F.contains("text", F.lit(" "))).withColumn("word", last).join(type_words(triples), "word", "left_semi").select("node", "text", F.expr("substring(text, 1, length(text) - length(substring_index(text, ' ', -1)) - 1)").alias("base"))
        found = found.union(rest)
    return found.filter((F.col("base") != "") & (F.lower("base") != F.lower("text"))).distinct()


def type_qualified_pairs(triples: DataFrame) -> DataFrame:
    """(a, b), a < b: a subject labelled ``X (type)`` or ``X type`` and one labelled X, sharing a type."""
    t = g.triple_set(triples)
    left = _bases(t, True).select("node", F.lower("base").alias("key")).distinct()
    pair = left.join(label_keys(t).select("key", F.col("node").alias("other")), "key").filter("node <> other")
    types = g.types(t).filter(~F.col("type").isin(v.SCHEMA_TYPES))
    shared = pair.join(types, "node").join(types.select(F.col("node").alias("other"), "type"), ["other", "type"])
    return shared.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def merge_type_qualified(triples: DataFrame) -> DataFrame:
    """The triples with each subject labelled ``X (type)`` or ``X type`` and its namesake X as one."""
    t = settled(g.triple_set(triples), "triples")
    # of a name and type every qualified subject is a namesake of every plain one: each is linked to the
    # smallest of them all instead
    types = g.types(t).filter(~F.col("type").isin(v.SCHEMA_TYPES))
    side = lambda df, plain: df.join(types, "node").select("key", "type", "node", F.lit(plain).alias("plain"))
    own = side(_bases(t, True).select("node", F.lower("base").alias("key")).distinct(), False).unionByName(side(label_keys(t), True))
    least = own.groupBy("key", "type").agg(F.min("node").alias("b"), F.bool_or("plain").alias("p"), F.bool_or(~F.col("plain")).alias("q")).filter("p AND q").select("key", "type", "b")
    return rewritten(t, kept_of(own.join(least, ["key", "type"]).select(F.col("node").alias("a"), "b").distinct(), t))


def with_aliases(triples: DataFrame) -> DataFrame:
    """The triples and the labels that ``bare_aliases`` finds."""
    return with_labels(triples, bare_aliases(triples).select("node", F.col("alias").alias("label")))


def bare_aliases(triples: DataFrame) -> DataFrame:
    """(node, text, alias): subjects with the one label ``X (type)`` where nobody else is labelled X."""
    t = g.triple_set(triples)
    own = t.filter((F.col("p") == v.LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("node")).agg(F.count_distinct(stripped(F.col("o"))).alias("n")).filter("n = 1")
    found = _bases(t, False).join(own, "node", "left_semi").withColumn("key", F.lower("base"))
    taken = label_keys(t).select("key", F.col("node").alias("other"))
    return found.join(taken, (found["key"] == taken["key"]) & (F.col("other") != F.col("node")), "left_anti").select("node", "text", F.col("base").alias("alias"))


def placeholder_values(triples: DataFrame) -> DataFrame:
    """(qid, value_lex): quantity nodes whose value isn't a number."""
    t = g.triple_set(triples).filter((F.col("p") == v.VALUE) & (F.col("o_kind") == "literal"))
    return t.filter(~F.col("o").rlike(NUMBER)).select(F.col("s").alias("qid"), F.col("o").alias("value_lex"))


def without_placeholders(triples: DataFrame) -> DataFrame:
    """Without those nodes and the triples that point to them."""
    bad = placeholder_values(triples).select("qid").distinct()
    t = g.triple_set(triples)
    return t.join(bad, F.col("s") == F.col("qid"), "left_anti").join(bad, F.col("o") == F.col("qid"), "left_anti")


#: Unit nodes named by another uri. Fixed values.
UNIT_ALIASES = {v.NS + "‰": v.NS + "Промил"}


def canonical_units(triples: DataFrame, aliases: dict[str, str] = UNIT_ALIASES) -> DataFrame:
    t = g.triple_set(triples)
    o = F.col("o")
    for a, b in aliases.items():
        o = F.when((F.col("p") == v.UNIT) & (F.col("o") == a), F.lit(b)).otherwise(o)
    return t.withColumn("o", o).distinct()


def _quantities(triples: DataFrame) -> DataFrame:
    """(s, p, qid, value_lex, unit_uri): links to nodes with a value."""
    t = g.triple_set(triples)
    return t.filter("o_kind = 'bnode'").select("s", "p", F.col("o").alias("qid")).join(g.quantity_values(t), "qid")


def repeated_quantities(triples: DataFrame) -> DataFrame:
    """(qid, kept): nodes that give a subject the value and unit of another, smaller node again."""
    q = _quantities(triples)
    kept = q.groupBy("s", "p", "value_lex", "unit_uri").agg(F.min("qid").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    same = (q["s"] == kept["s"]) & (q["p"] == kept["p"]) & (q["value_lex"] == kept["value_lex"]) & q["unit_uri"].eqNullSafe(kept["unit_uri"])
    return q.join(kept, same).filter("qid <> kept").select("qid", "kept").distinct()


def without_repeated_quantities(triples: DataFrame) -> DataFrame:
    gone = repeated_quantities(triples).select("qid").distinct()
    t = g.triple_set(triples)
    return t.join(gone, F.col("s") == F.col("qid"), "left_anti").join(gone, F.col("o") == F.col("qid"), "left_anti")


def conflicting_quantities(triples: DataFrame) -> DataFrame:
    """(s, p, readings): the different values with units of a subject and property that has several."""
    q = _quantities(triples).withColumn("reading", F.concat_ws(" ", "value_lex", "unit_uri"))
    return q.groupBy("s", "p").agg(F.array_sort(F.collect_set("reading")).alias("readings")).filter(F.size("readings") > 1)


def missing_labels(triples: DataFrame) -> DataFrame:
    """(node, label): typed nodes of the namespace without label, with a derived one."""
    t = g.triple_set(triples)
    typed = t.filter((F.col("p") == v.TYPE) & (F.col("s_kind") == "uri") & F.startswith("s", F.lit(v.NS))).select(F.col("s").alias("node")).distinct()
    return typed.join(t.filter(F.col("p") == v.LABEL).select(F.col("s").alias("node")), "node", "left_anti").select("node", g.derived_label(F.col("node")).alias("label"))


def with_labels(triples: DataFrame, found: DataFrame, lang: str = "bg") -> DataFrame:
    """The triples and a label triple for each (node, label)."""
    new = found.select(F.col("node").alias("s"), F.lit("uri").alias("s_kind"), F.lit(v.LABEL).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(lang).alias("o_lang"))
    return g.triple_set(triples).unionByName(new).distinct()


def curated(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All passes in order, and a report (pass, changed)."""
    reports = []
    def note(name, df):
        reports.append(df.agg(F.count("*").alias("changed")).select(F.lit(name).alias("pass"), "changed"))

    t = settled(g.triple_set(triples), "curate")
    note("merged_labels", merge_map(t))
    note("ambiguous_labels", label_groups(t).filter("shared = 0"))
    t = settled(merge_duplicate_labels(t), "curate")
    note("placeholder_values", placeholder_values(t))
    t = settled(without_placeholders(t), "curate")
    note("unit_aliases", t.filter((F.col("p") == v.UNIT) & F.col("o").isin(list(UNIT_ALIASES))))
    t = settled(canonical_units(t), "curate")
    note("repeated_quantities", repeated_quantities(t))
    t = settled(without_repeated_quantities(t), "curate")
    note("conflicting_quantities", conflicting_quantities(t))
    note("labels_added", missing_labels(t))
    t = with_labels(t, missing_labels(t))
    report = reports[0]
    for r in reports[1:]:
        report = report.union(r)
    return t, report
