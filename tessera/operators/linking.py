"""Entities named in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import bound, stem, stripped, words
from ..sources.tables import settled
from .meeting import beside, sieve

#: Shortest label that is looked for.
SHORTEST = 4

#: Most characters of a label by which it and the texts are met.
LONGEST = 8


def label_index(triples: DataFrame) -> DataFrame:
    """(label, node): labels in lower case of at least four characters, one node (the largest) each."""
    t = triples.filter((F.col("p") == v.LABEL) & (F.col("o_kind") == "literal") & F.col("s").isNotNull())
    return t.groupBy(F.lower(stripped(F.col("o"))).alias("label")).agg(F.max("s").alias("node")).filter(F.length("label") >= SHORTEST)


def linked(texts: DataFrame, index: DataFrame, k: int = v.LINKED_ONLINE) -> DataFrame:
    """(query_id, rank, node, label): labels contained in the text (query_id, text), the longest first,
    one for each node, at most ``k``.

    A place of a text meets the labels that begin with its first eight characters, shorter ones at all of
    theirs; what follows is compared there. So the pairs of texts and labels are never enumerated, and places
    where no label begins and labels that no text begins aren't moved.
    """
    low = F.lower("text")
    starts = bound(low, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - SHORTEST + 1), lambda i: F.substring(x, i, F.lit(SHORTEST))))
    index = index.withColumn("key", F.substring("label", 1, LONGEST))
    begun, known, longest = sieve(index.select(F.substring("label", 1, SHORTEST).alias("start"))), sieve(index.select("key")), index.agg(F.max(F.length("label"))).scalar()
    places = texts.filter(F.length(low) >= SHORTEST).select("query_id", low.alias("low"), F.posexplode(starts).alias("at", "start")).filter(begun(F.col("start")))
    keys = F.array_distinct(F.array(*[F.substring("low", F.col("at") + 1, F.lit(n)) for n in range(SHORTEST, LONGEST + 1)]))
    keyed = places.select("query_id", "low", "at", F.explode(keys).alias("key")).filter(known(F.col("key")))
    # a key like the beginning of a common word may stand anywhere: its places are dealt over parts
    places = settled(keyed.select("query_id", "at", "key", F.substring("low", F.col("at") + 1, longest).alias("rest")), "places")
    stands = sieve(places.select("key"))
    met = beside(places, index.filter(stands(F.col("key"))), "key", ["query_id", "at"])
    held = met.filter(F.substring(F.col("rest"), F.lit(1), F.length("label")) == F.col("label")).select("query_id", "label", "node").distinct()
    one = held.groupBy("query_id", "node").agg(F.min_by("label", F.struct(-F.length("label"), "label")).alias("label"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.length("label")), "label"))
    return one.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "node", "label")


def content_words(c: Column) -> Column:
    """Words of at least four characters without signs at their ends, in lower case."""
    bare = F.transform(words(F.lower(c)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: F.length(w) >= SHORTEST)


def _by_stems(texts: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, begun): the stems of labels that begin words of each text, and (label, node, stems, stem):
    the stems of each label, null for one alone, and one at which it is met.

    A stem like that of a common word stands in any share of the labels and of the texts, so a label isn't
    met at all of its stems but at the one that begins words of the fewest texts. From three stems on one
    may be missing: it is met at the two rarest, and at the rarer of the first two. Stems that begin no word
    of any text are left out.
    """
    read = texts.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(content_words(F.col("text"))))).alias("words"))
    prefixes = F.flatten(F.transform(F.col("words"), lambda w: F.transform(F.sequence(F.lit(SHORTEST), F.length(w)), lambda k: F.substring(w, F.lit(1), k))))
    stems = index.select("label", "node", F.transform(content_words(F.col("label")), stem).alias("stems")).filter(F.size("stems") > 0)
    one = stems.select("label", "node", F.posexplode("stems").alias("i", "stem"))
    known = sieve(one.select("stem"))
    begun = read.select("query_id", F.explode(F.array_distinct(prefixes)).alias("stem")).filter(known(F.col("stem")))
    bags = settled(begun.groupBy("query_id").agg(F.collect_list("stem").alias("begun")), "stems")
    counts = bags.select(F.explode("begun").alias("stem")).groupBy("stem").agg(F.count("*").alias("texts"))
    rarest = one.join(counts, "stem", "left").groupBy("label", "node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "i", "stem"))).alias("by"))
    n = F.size("by")
    ways = F.concat(F.slice("by", 1, F.when(n >= 3, 2).otherwise(1)), F.slice(F.filter("by", lambda x: x["i"] < 2), 1, F.when(n >= 3, 1).otherwise(0)))
    met_at = F.array_distinct(F.transform(F.filter(ways, lambda x: x["texts"] > 0), lambda x: x["stem"]))
    in_order = F.transform(F.array_sort(F.transform("by", lambda x: F.struct(x["i"], x["stem"]))), lambda x: x["stem"])
    # where the one stem of a label is met nothing is left to look for
    return bags, settled(rarest.select("label", "node", F.when(n > 1, in_order).alias("stems"), F.explode(met_at).alias("stem")), "keys")


def _met(bags: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Texts and keys (stem, stems) that meet at a stem, where enough of the others begin words of the text too."""
    wanted = sieve(keys.select("stem"))
    own = bags.select("*", F.explode("begun").alias("stem")).filter(wanted(F.col("stem")))
    stands = lambda s: F.array_contains("begun", s)
    n, hits, first = F.size("stems"), F.size(F.filter("stems", stands)), F.size(F.filter(F.slice("stems", 1, 2), stands))
    return beside(own, keys, "stem", [by]).filter((hits == n) | ((n >= 3) & ((hits >= n - 1) | (first == 2))))


def fuzzy_linked(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, node, label): labels whose word stems begin words of the text: all of them, or of three and
    more all but one, or the first two."""
    bags, keys = _by_stems(texts, index)
    sure = bags.select("query_id", F.explode("begun").alias("stem")).join(keys.filter("stems IS NULL"), "stem").select("query_id", "node", "label")
    return sure.unionByName(_met(bags, keys.filter("stems IS NOT NULL"), "query_id").select("query_id", "node", "label").distinct())


def fuzzy_nodes(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(node): what any of the texts links to by stems, as ``fuzzy_linked`` has it, repeated rows included.

    Which text it is doesn't matter, so a label of one stem that begins any word is held, and of labels with
    the same stems one meets the texts."""
    bags, keys = _by_stems(texts, index)
    several = keys.filter("stems IS NOT NULL")
    held = _met(bags, several.select("stem", "stems").distinct(), "begun").select("stems").distinct()
    return keys.filter("stems IS NULL").select("node").union(several.join(held, "stems", "left_semi").select("node"))


def seeds(texts: DataFrame, triples: DataFrame) -> DataFrame:
    """(node): what any of the texts links to, exactly (16 each) or by stems."""
    texts, index = settled(texts, "texts"), settled(label_index(triples), "index")
    return linked(texts, index, v.LINKED_PER_QUESTION).select("node").union(fuzzy_nodes(texts, index)).distinct()
