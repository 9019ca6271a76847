"""Queries over pages, chunks, vectors, questions and answers, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocabulary as v
from ..operators import chunking, dataset, evaluation, evidence, extraction, graph, ranking, vectors
from ..sources.tables import settled, spread, table
from . import graph_queries as gq
from .graph_queries import _list, _squeeze, _strip, keywords_sql


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_pages")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages for work on their content."""
    return spread(_pages(spark, d).select("page_id", "title", "content", "source_file"))


def doc_clean_article(spark, d):
    return _texts(spark, d).select("page_id", tx.plain_article(F.col("content")).alias("text"))


def doc_clean_wiki(spark, d):
    return _texts(spark, d).select("page_id", tx.plain_wiki(F.col("content")).alias("text"))


def doc_extraction_text(spark, d):
    """Cleaned pages as an extraction model is given them: its limit is 6000 characters."""
    return _texts(spark, d).select("page_id", F.substring(tx.plain_wiki(F.col("content")), 1, 6000).alias("text"))


def doc_truncate_section(spark, d):
    return _texts(spark, d).select("page_id", tx.cut_at_markers(F.col("content")).alias("text"))


def doc_clean_stats(spark, d):
    p = _texts(spark, d).select("source_file", F.coalesce(F.length("content"), F.lit(0)).alias("a"), F.coalesce(F.length(tx.cut_at_markers(F.col("content"))), F.lit(0)).alias("b"))
    s = p.groupBy("source_file").agg(F.count("*").alias("pages"), F.count_if(F.expr("b < a")).alias("cleaned"), F.sum(F.col("a") - F.col("b")).alias("chars_removed"), F.sum("a").alias("chars"))
    return s.select("source_file", "pages", "cleaned", "chars_removed", evaluation.percent(F.col("chars_removed"), F.col("chars")).alias("percent_removed"))


def doc_dedup_titles(spark, d):
    return dataset.deduplicated_pages(_pages(spark, d)).select("page_id", "title")


def doc_dup_counts(spark, d):
    return dataset.repeated_titles(_pages(spark, d))


def doc_split_halves(spark, d):
    return dataset.halves(_pages(spark, d).select("page_id"), "page_id")


def doc_title_search(spark, d):
    """For each chunk title, the page whose title has the same first five letters: the smallest."""
    key = lambda c: F.substring(F.lower(c), 1, 5)
    pages = _pages(spark, d).filter("title IS NOT NULL").groupBy(key(F.col("title")).alias("k")).agg(F.min("title").alias("found"))
    return table(spark, d, "chunks").filter("title IS NOT NULL").select("title").distinct().withColumn("k", key(F.col("title"))).join(pages, "k").select("title", "found")


def chunk_fixed256(spark, d):
    return chunking.fixed(_texts(spark, d)).select("page_id", "chunk_index", "text")


def chunk_fixed500(spark, d):
    return chunking.fixed(_texts(spark, d), 500, 50).select("page_id", "chunk_index", "text")


def chunk_structure(spark, d):
    return chunking.structure(_texts(spark, d)).select("page_id", "section", "chunk_index", "text")


def chunk_parents(spark, d):
    return chunking.parents(_texts(spark, d)).select("page_id", "parent_id", "section", "text")


def chunk_parent_child(spark, d):
    return chunking.chunked(_texts(spark, d), "parentchild").select("page_id", "parent_id", "chunk_index", "text")


def parent_expand(spark, d):
    """The chunks of each title, in order of their index, with their parents' text."""
    c = table(spark, d, "chunks").filter("text IS NOT NULL AND title IS NOT NULL")
    hits = c.select(F.col("title").alias("query_id"), F.row_number().over(Window.partitionBy("title").orderBy("chunk_index", "chunk_id")).alias("rank"), F.col("chunk_id").alias("doc_id"), "parent_id", "text")
    parents = chunking.parents(_pages(spark, d)).groupBy("parent_id").agg(F.min("text").alias("text"))
    return chunking.with_parents(hits, parents)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return _vectors(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _top(spark, d, metric):
    return vectors.top_k(_query_vectors(spark, d), _vectors(spark, d), 10, metric).select("query_id", "vec_id", "rank", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


def vec_topk_cosine(spark, d):
    return _top(spark, d, "cosine")


def vec_topk_l2(spark, d):
    return _top(spark, d, "l2")


def vec_topk_ip(spark, d):
    return _top(spark, d, "ip")


def vec_knn_label_accuracy(spark, d):
    hits = vectors.top_k(_query_vectors(spark, d), _vectors(spark, d), 10, "cosine", exclude_self=True)
    found = vectors.majority_label(hits, _vectors(spark, d).select("vec_id", "label"))
    gold = _vectors(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("gold"))
    return evaluation.accuracy(found.select("query_id", F.col("predicted").cast("string")).join(gold, "query_id"))


def vec_cosine_label_centers(spark, d):
    """The cosine of each vector with the mean of its label."""
    one = _vectors(spark, d).select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = one.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("center"))
    return _vectors(spark, d).join(mean, "label").select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("center")), 6).alias("similarity"))


def _candidates(spark: SparkSession, d: str, ready: bool = False) -> DataFrame:
    """(query_id, query, cand_id, text, ...): the facts next to what a described node's text names. ready: with
    what the stem score needs of a query and of a fact, found once for each."""
    near = gq.kg_nhop_1(spark, d).select("query_id", "s", "p", "o")
    f = graph.facts(table(spark, d, "triples")).withColumn("o", F.coalesce("object_bnode_id", "object_uri", "object_value"))
    own = ["query_id", F.col("text").alias("cand_id"), "text", "subject_uri", "predicate_uri", "object_uri", "predicate_importance"]
    queries = gq._texts(spark, d).withColumnRenamed("text", "query")
    if ready:
        f, queries, own = settled(f.withColumn("text_ready", ranking.ready(F.col("text"))), "facts-ready"), settled(queries.withColumn("query_ready", ranking.ready(F.col("query"))), "queries-ready"), [*own, "text_ready"]
    told = near.join(f, (near["s"] == f["subject_uri"]) & (near["p"] == f["predicate_uri"]) & (near["o"] == f["o"]))
    return told.select(*own).join(queries, "query_id")


def rank_lexical(spark, d):
    return ranking.ranked(_candidates(spark, d), ranking.lexical_score(F.col("query"), F.col("text")), 30).select("query_id", "rank", "text", "score")


def rank_stem_lexical(spark, d):
    return ranking.ranked(_candidates(spark, d, ready=True), ranking.ready_stem_score("query_ready", "text_ready"), 30).select("query_id", "rank", "text", "score")


def vec_rerank_domain(spark, d):
    """The domain score of each question's candidates with the types of their subjects; the distance is the
    closer the more keywords they share."""
    kinds = graph.type_names(graph.triple_set(table(spark, d, "triples")), v.IGNORED_SUBJECT_TYPES).select(F.col("node").alias("subject_uri"), F.col("types").alias("subject_types"))
    c = _candidates(spark, d).join(kinds, "subject_uri", "left")
    question = F.concat(F.lit("Колко е височината и площта на "), "query")
    distance = 1.0 / (1.0 + ranking.lexical_score(F.col("query"), F.col("text")))
    s = vectors.domain_score(question, distance, F.col("predicate_uri"), F.col("object_uri"), F.col("text"), F.col("predicate_importance"), F.col("subject_types"))
    return ranking.ranked(c, -s, 10).select("query_id", "rank", "text", F.round(-F.col("score"), 4).alias("score"))


def rank_two_stage_protected(spark, d):
    c = settled(_candidates(spark, d), "candidates")
    s = c.select("query_id", "cand_id", (F.col("predicate_importance") == 1).alias("protected"), ranking.lexical_score(F.col("query"), F.col("text")).alias("coarse_score"), ranking.stem_score(F.col("query"), F.col("text")).alias("fine_score"))
    return ranking.funnel(s, 40, 15)


def _ranked_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("text IS NOT NULL AND title IS NOT NULL")
    return c.select(F.col("title").alias("query_id"), F.row_number().over(Window.partitionBy("title").orderBy("chunk_index", "chunk_id")).alias("rank"), "text")


def rank_context_budget(spark, d):
    return ranking.within_budget(_ranked_chunks(spark, d), 300).select("query_id", "rank", "words_so_far")


def rank_topup(spark, d):
    kept = F.coalesce(F.col("text").contains("язовир"), F.lit(False))
    return ranking.topped_up(_ranked_chunks(spark, d).withColumn("kept", kept), 3).select("query_id", "rank", "kept")


def rank_fallback(spark, d):
    hits = _ranked_chunks(spark, d)
    return ranking.context_or_fallback(hits, hits.filter(F.col("text").contains("язовир")), 2).select("query_id", F.size("context").alias("n"), "fallback")


def filter_selection(spark, d):
    """A reply that names the second and first chunk of each title, with numbers before them."""
    hits = settled(_ranked_chunks(spark, d), "hits")
    chosen = hits.filter("rank <= 2").groupBy("query_id").agg(F.to_json(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("rank", "text")))), lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["text"]))).alias("reply"))
    return extraction.selected(chosen, hits).select("query_id", F.md5("text").alias("text_md5"), "used").distinct()


def relevant_names(spark, d):
    """The nodes whose names a described node's text touches."""
    names = table(spark, d, "triples").filter(F.col("s").startswith(v.NS)).select(F.substring_index("s", "#", -1).alias("name")).distinct()
    return extraction.relevant_names(names, gq._texts(spark, d).withColumnRenamed("query_id", "text_id"))


def cache_hit_rate(spark, d):
    """The texts of chunks against a cache that holds those of the first chunk of each file."""
    c = table(spark, d, "chunks").filter("text IS NOT NULL")
    cache = c.filter("chunk_index = 0").select("text").distinct().withColumn("vector", F.array(F.lit(0.0)))
    hit = vectors.cached_vectors(c, cache, lambda m: m.withColumn("vector", F.array(F.lit(0.0))))
    return hit.agg(F.count("*").alias("texts"), F.count_if("hit").alias("hits"), evaluation.percent(F.count_if("hit"), F.count("*")).alias("rate"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """Questions with answers from the keys, whose urls are short, and long urls."""
    q = dataset.with_long_urls(_questions(spark, d).select("id", "qid", "url", "question", "answers", "correct"), table(spark, d, "url_map"))
    keys = dataset.with_long_urls(table(spark, d, "answer_keys").select("qid", "url", "correct"), table(spark, d, "url_map"))
    return dataset.with_answers(q, keys)


def answers_join(spark, d):
    return _mapped(spark, d).select("id", "qid", "url", "correct").distinct()


def url_remap(spark, d):
    return dataset.with_long_urls(_questions(spark, d).select("id", "url"), table(spark, d, "url_map")).groupBy("url").agg(F.count("*").alias("n"))


def homoglyph_fix(spark, d):
    return dataset.mended_questions(_questions(spark, d).select("id", "question", "answers", "correct")).select("id", "question", "answers", "correct", "changed").distinct()


def testset_build(spark, d):
    return dataset.test_records(_mapped(spark, d), "new").select("id", "qid", "source_url", "source_dataset", "question", "correct_answer").distinct()


def testset_merge(spark, d):
    older = table(spark, d, "bench_items").select("id", "qid", "question")
    return dataset.merged_questions(older, _questions(spark, d).select("id", "qid", "question")).select("id", "question")


def text_normalise_key(spark, d):
    return _questions(spark, d).select("id", tx.question_key(F.col("question")).alias("key")).distinct()


def overlap_semi(spark, d):
    return dataset.overlap(_questions(spark, d).select("id", "question"), _questions(spark, d).filter("correct IS NULL")).distinct()


def overlap_anti(spark, d):
    return dataset.overlap(_questions(spark, d).select("id", "question"), table(spark, d, "bench_items"), new_only=True).distinct()


def sample_stratified(spark, d):
    return dataset.stratified(table(spark, d, "bench_items").select("id", "source_dataset"), "source_dataset", "id", 60)


def batch_slice(spark, d):
    return dataset.batch(table(spark, d, "bench_items").select("id", "qid"), "id", 100, 100)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.model_answers(table(spark, d, "bench_items"))


def resume_pending(spark, d):
    done = _runs(spark, d).filter("model = 'model-a'").select("id", F.col("predicted").alias("answer"))
    return dataset.pending(table(spark, d, "bench_items").select("id", "qid"), done)


def overlap_annotated(spark, d):
    return dataset.annotated(_questions(spark, d).select("id", "question"), table(spark, d, "bench_items")).distinct()


def eval_errors(spark, d):
    """The wrong answers of each model."""
    return evaluation.errors(_runs(spark, d)).select("id", "model", "predicted", "gold")


def merge_runs(spark, d):
    """Rows and repeated questions of the question batches by exam."""
    q = _questions(spark, d)
    return q.groupBy("url").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("question")).alias("repeated"))


def mcq_prompt(spark, d):
    return table(spark, d, "bench_items").select("id", dataset.prompt(F.col("question"), F.col("options")).alias("prompt"))


def mcq_letter(spark, d):
    """The letter that stands in each text of the answers, as if it were a reply."""
    return _questions(spark, d).select("id", F.posexplode("answers").alias("i", "reply")).select("id", "i", tx.answer_letter(F.col("reply")).alias("letter")).distinct()


def grounded_prompts(spark, d):
    first = _ranked_chunks(spark, d).filter("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("c"))
    return first.select("query_id", F.md5(dataset.grounded_prompt(F.col("c"), F.col("query_id"))).alias("prompt_md5"))


def extract_year(spark, d):
    return _questions(spark, d).filter("url IS NOT NULL").groupBy(tx.year_of(F.col("url")).alias("year")).agg(F.count("*").alias("n"))


def classify_domain(spark, d):
    text = F.concat_ws(" ", "question", F.array_join(F.transform("options", lambda o: tx.option_text(o["text"])), " "))
    return table(spark, d, "bench_items").select("id", evaluation.domain(text).alias("domain"))


def classify_bucket(spark, d):
    return _questions(spark, d).select("id", evaluation.topic(F.col("question")).alias("topic"), evaluation.about_country(F.col("question")).alias("about_country")).distinct()


def eval_accuracy(spark, d):
    return evaluation.accuracy(_runs(spark, d), ["model"])


def eval_slices(spark, d):
    return evaluation.accuracy(_runs(spark, d), ["model", "source_dataset"])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(model, id, answer, gold, recall, ctx_n): runs with the first 15 documents of evidence as context."""
    ctx = _evidence(spark, d).select("id", F.col("stem_15").alias("recall"), F.least("ctx_n", F.lit(15)).alias("ctx_n"))
    r = _runs(spark, d).join(ctx, "id")
    return r.select("model", "source_dataset", "id", F.col("predicted").alias("answer"), "gold", F.when(F.col("gold") != "-", F.col("recall")).alias("recall"), F.when(F.col("predicted") == "-", 0).otherwise(F.col("ctx_n")).alias("ctx_n"))


def eval_run_metrics(spark, d):
    return evaluation.run_metrics(_scored(spark, d), ["model"])


def eval_console_metrics(spark, d):
    return evaluation.console_metrics(_scored(spark, d), ["model"])


def eval_hybrid(spark, d):
    runs = _scored(spark, d)
    mixed = evaluation.hybrid(runs.filter("model = 'model-b'").select("id", "answer", "gold"), runs.filter("model = 'model-a'").select("id", "answer"))
    return evaluation.accuracy(mixed.withColumnRenamed("answer", "predicted"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items with whether the documents that share a name with them hold the gold answer: all, the
    first 60 and the first 15 by three scorers."""
    b = table(spark, d, "bench_items")
    text = F.concat_ws(" ", "question", F.array_join(F.transform("options", lambda o: tx.option_text(o["text"])), " "))
    gold = b.select("id", evaluation.domain(text).alias("domain"), dataset.gold_text(F.col("options"), F.col("correct_answer")).alias("gold"))
    placed = settled(evidence.ranked(b.select("id", "question"), spread(table(spark, d, "documents").select("doc_id", "text"))), "evidence")
    return settled(evidence.recalls(gold, placed), "recalls")


def eval_recall_proxy(spark, d):
    """Whether a question's gold answer occurs in its evidence."""
    return _evidence(spark, d).select("id", "ctx_n", "recall", F.col("stem_15").alias("recall_15"))


def eval_coverage(spark, d):
    """Coverage by domain of all evidence and of the first 60 and 15 by stems."""
    e = _evidence(spark, d)
    parts = [evaluation.coverage(e.select("domain", F.col(c).alias("recall"))).withColumn("cut", F.lit(name)) for name, c in (("all", "recall"), ("60", "stem_60"), ("15", "stem_15"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def eval_survival(spark, d):
    """How much of the evidence each scorer keeps among the first 60 and 15."""
    e = _evidence(spark, d)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_60").alias("r60"), F.col(f"{a}_15").alias("r15")) for a in evidence.ARMS])
    return evaluation.survival(e.select(F.col("recall").alias("oracle"), F.explode(arms).alias("x")).select("oracle", "x.*"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_clean_article, doc_clean_wiki, doc_extraction_text, doc_truncate_section, doc_clean_stats, doc_dedup_titles, doc_dup_counts, doc_split_halves, doc_title_search,
        chunk_fixed256, chunk_fixed500, chunk_structure, chunk_parents, chunk_parent_child, parent_expand, vec_topk_cosine, vec_topk_l2, vec_topk_ip, vec_knn_label_accuracy,
        vec_cosine_label_centers, vec_rerank_domain, rank_lexical, rank_stem_lexical, rank_two_stage_protected, rank_context_budget, rank_topup, rank_fallback, filter_selection, relevant_names, cache_hit_rate,
        answers_join, url_remap, homoglyph_fix, testset_build, testset_merge, text_normalise_key, overlap_semi, overlap_anti, overlap_annotated, sample_stratified, batch_slice, resume_pending,
        merge_runs, mcq_prompt, mcq_letter, grounded_prompts, extract_year, classify_domain, classify_bucket, eval_accuracy, eval_errors, eval_slices, eval_run_metrics, eval_console_metrics,
        eval_hybrid, eval_recall_proxy, eval_coverage, eval_survival,
    )
}


# The same in SQL

_W = "list_filter(string_split_regex({x}, '" + gq._SP + "+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return _W.replace("{x}", x)


def _wiki(x: str) -> str:
    for pattern, by, flags in (
        (rf"(?sm)^\s*==\s*({'|'.join(v.SECTIONS)})\s*==.*", "", "gi"), ("(?s)<ref.*?>.*?</ref>", "", "gi"), (r"(?s)\{\{.*?\}\}", "", "g"), (r"\[\[Файл:.*?\]\]", "", "gi"), (r"\[\[Категория:.*?\]\]", "", "gi"),
        ("'''(.*?)'''", r"\1", "g"), ("''(.*?)''", r"\1", "g"), (r"==+\s*(.*?)\s*==+", "\n\n\\1\n", "g"), (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1", "g"), ("\n{3,}", "\n\n", "g"), ("[ \t]+", " ", "g"),
    ):
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', '{flags}')"
    return _strip(x)


_FIRST = "list_min(list_filter([" + ", ".join(f"instr(content, '{m}')" for m in v.MARKERS) + "], lambda x: x > 0))"
_CUT = f"CASE WHEN {_FIRST} IS NOT NULL THEN {_strip(f'substr(content, 1, {_FIRST} - 1)')} ELSE content END"
_PAGES = "pages AS (SELECT page_id, coalesce(title, 'Unknown') AS title, content, coalesce(source_file, 'unknown') AS source_file FROM wiki_pages WHERE regexp_matches(content, '[^\\s\\p{Z}]'))"


def _windows(source: str, size: int, overlap: int, columns: str, words: str = "w") -> str:
    stride = max(1, size - overlap)
    return f"SELECT {columns}, CAST(i AS INTEGER) AS i, array_to_string({words}[i * {stride} + 1 : i * {stride} + {size}], ' ') AS text FROM (SELECT *, unnest(generate_series(0, CASE WHEN len({words}) <= {size} THEN 0 ELSE CAST(ceil((len({words}) - {size}) / {float(stride)}) AS BIGINT) END)) AS i FROM {source})"


def _fixed(tokens: int, overlap: int) -> str:
    return f"WITH {_PAGES}, w AS (SELECT page_id, {_words('content')} AS w FROM pages) SELECT page_id, i AS chunk_index, text FROM ({_windows('w', chunking.in_words(tokens), chunking.in_words(overlap), 'page_id')})"


_HEADING = r"==\s*(.+?)\s*=="
_SECTIONS = f"""{_PAGES}, split AS (SELECT *, string_split_regex(content, '{_HEADING}') AS bodies, regexp_extract_all(content, '{_HEADING}', 1) AS heads FROM pages),
sec AS MATERIALIZED (SELECT page_id, title, source_file, s, section, body, {_words('body')} AS w FROM (SELECT page_id, title, source_file, CAST(s AS INTEGER) AS s, CASE WHEN s = 0 THEN '' ELSE heads[s] END AS section, {_strip('bodies[s + 1]')} AS body FROM (SELECT *, unnest(generate_series(0, len(bodies) - 1)) AS s FROM split)) WHERE body <> '')"""
_HEAD = "title || CASE WHEN section <> '' THEN ': ' || section ELSE '' END || chr(10)"
_PARENTS = f"{_SECTIONS}, par AS MATERIALIZED (SELECT page_id, s, title, section, source_file, i AS m, concat_ws('::', source_file, title, 's' || s, 'p' || i) AS parent_id, text, {_words('text')} AS w FROM ({_windows('sec', 393, 0, 'page_id, s, title, section, source_file')}))"
_HITS = "hits AS MATERIALIZED (SELECT title AS query_id, CAST(row_number() OVER (PARTITION BY title ORDER BY chunk_index NULLS FIRST, chunk_id) AS INTEGER) AS rank, chunk_id AS doc_id, parent_id, text FROM chunks WHERE text IS NOT NULL AND title IS NOT NULL)"


def _knn(distance: str, extra: str = "") -> str:
    return f"""v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, x.vec_id, {distance} AS dist FROM v q JOIN v x ON q.vec_id % 100 = 0 {extra}),
top AS MATERIALIZED (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank, round(dist, 6) + 0.0 AS distance FROM near QUALIFY rank <= 10)"""


_COS = "1 - list_dot_product(q.e, x.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(x.e, x.e)))"
_CAND = f"""{gq._FACTS}, edges AS MATERIALIZED (SELECT * FROM t WHERE p NOT IN ({_list(v.SKIPPED_PREDICATES)})), {gq._L}, {gq._HOP1},
cand AS MATERIALIZED (SELECT h.query_id, x.text AS query, f.text, f.s, f.p, CASE WHEN f.o_kind = 'uri' THEN f.o END AS object_uri, {gq._IMPORTANCE.replace(' p ', ' f.p ').replace('(p,', '(f.p,')} AS imp FROM (SELECT DISTINCT query_id, s, p, o FROM hop1) h JOIN facts f ON f.s = h.s AND f.p = h.p AND h.o = CASE WHEN f.o_kind IN ('bnode', 'uri') THEN f.o WHEN f.kind = 'quantity' THEN f.value_lex ELSE f.o END JOIN texts x ON x.query_id = h.query_id)"""


def _rank(score: str) -> str:
    return f"WITH {_CAND} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text) AS INTEGER) AS rank, text, score FROM (SELECT query_id, text, {score} AS score FROM cand) QUALIFY rank <= 30"


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


_Q = "lower('Колко е височината и площта на ' || query)"
_AFFINE = "(" + " OR ".join(f"(contains({_Q}, '{a}') AND contains(lower(split_part(p, '#', -1)), '{b}'))" for a, b in v.AFFINITY.items()) + ")"
_TYPED = f"(length(w) > 3 AND w NOT IN ({_list(v.PLAIN_NOUNS)}) AND contains(lower(coalesce(subject_types, '')), w) AND contains(lower(text), w))"
_DOMAIN_SCORE = f"""0.8 * (1.0 / (1.0 + {gq.lexical_sql('query', 'text')})) + 1.5 * imp
 + CASE WHEN NOT coalesce(p = '{v.COUNTRY_PREDICATE}' AND object_uri = '{v.COUNTRY}', false) THEN 0.0 WHEN {_any(_Q, v.COUNTRY_ASKED)} THEN 0.0 WHEN {_any(_Q, v.COUNTRY_OFF)} THEN 60.0 ELSE 30.0 END
 + CASE WHEN {_any(_Q, v.QUANTITY_STEMS)} AND p IN ({_list(v.QUANTITY_PROPERTIES)}) THEN CASE WHEN {_AFFINE} THEN -60.0 ELSE -15.0 END + CASE WHEN len(list_filter({_words(_Q)}, lambda w: {_TYPED})) > 0 THEN -5.0 ELSE 0.0 END ELSE 0.0 END
 + greatest(-20.0, -({gq.lexical_sql("'Колко е височината и площта на ' || query", 'text')}))"""
_MAPPED = """um AS (SELECT current_url AS url, min(new_url) AS new_url FROM url_map WHERE current_url IS NOT NULL GROUP BY 1),
ak AS (SELECT qid, url, min(correct) AS k FROM (SELECT a.qid, coalesce(m.new_url, a.url) AS url, a.correct FROM answer_keys a LEFT JOIN um m ON m.url = a.url) WHERE qid IS NOT NULL AND url IS NOT NULL AND correct BETWEEN 1 AND 4 GROUP BY 1, 2),
mapped AS MATERIALIZED (SELECT q.id, q.qid, q.url, q.question, q.answers, coalesce(q.answers[a.k], q.correct) AS correct FROM (SELECT q.id, q.qid, coalesce(m.new_url, q.url) AS url, q.question, q.answers, q.correct FROM questions q LEFT JOIN um m ON m.url = q.url) q LEFT JOIN ak a ON a.qid = q.qid AND a.url = q.url)"""


def _mend(x: str) -> str:
    for a, b in v.CORRECTIONS.items():
        x = f"replace({x}, '{a}', '{b}')"
    # split into runs of blanks and of other characters, as alternatives of one pattern
    parts = rf"regexp_extract_all({x}, '{gq._SP}+|[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+')"
    return f"array_to_string(list_transform({parts}, lambda w: CASE WHEN regexp_matches(w, '[a-zA-Z]') AND regexp_matches(w, '[а-яА-ЯёЁ]') THEN translate(w, '{v.LATIN}', '{v.CYRILLIC}') ELSE w END), '')"


def _key(x: str) -> str:
    return f"regexp_replace({_squeeze(f'lower(nfc_normalize({x}))')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g')"


def _option(x: str) -> str:
    return _strip(f"regexp_replace({_strip(x)}, '^[А-ГA-D][).]\\s*', '')")


_RUNS = "runs AS MATERIALIZED (SELECT id, coalesce(source_dataset, 'unknown') AS source_dataset, correct_answer AS gold, unnest(map_keys(model_answers)) AS model, unnest(map_values(model_answers)) AS predicted FROM bench_items)"
_PCT = "CASE WHEN {w} > 0 THEN round({p} * 100.0 / {w}, 4) ELSE 0.0 END"


def _pct(p: str, w: str) -> str:
    return f"CASE WHEN {w} > 0 THEN CAST(round(CAST({p} AS DOUBLE) * 100.0 / {w}, 4) AS DOUBLE) ELSE 0.0 END"


def _accuracy(source: str, by: str) -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}total, correct, {_pct('correct', 'total')} AS accuracy FROM (SELECT {g}count(*) AS total, count(*) FILTER (predicted = gold) AS correct FROM {source} WHERE predicted IS NOT NULL AND predicted <> '' AND gold IS NOT NULL {'GROUP BY ' + by if by else ''})"


def _recall(gold: str, ctx: str) -> str:
    long_words = f"list_filter({_words(f'lower({gold})')}, lambda w: length(w) > 3)"
    return f"CASE WHEN {gold} IS NULL OR {gold} = '' THEN false WHEN len({long_words}) > 0 THEN len(list_filter({long_words}, lambda w: contains(lower(coalesce({ctx}, '')), w))) / len({long_words}) >= 0.5 ELSE contains(lower(coalesce({ctx}, '')), lower({gold})) END"


_GOLD = _option("list_filter(options, lambda o: o.label = correct_answer)[1].text")
_ITEM = f"concat_ws(' ', question, array_to_string(list_transform(options, lambda o: {_option('o.text')}), ' '))"
_DOMAIN = "CASE " + " ".join(f"WHEN {_any('lower(' + _ITEM + ')', parts)} THEN '{name}'" for name, parts in v.DOMAINS.items()) + " ELSE 'bg_physical_geo' END"
_HITSOF = {name: " + ".join(f"CAST(contains(lower(question), '{p}') AS INTEGER)" for p in parts) for name, parts in v.TOPICS.items()}
_TOPIC = "CASE WHEN question IS NULL THEN NULL WHEN list_max([" + ", ".join(_HITSOF.values()) + "]) = 0 THEN 'other' ELSE [" + _list(v.TOPICS) + "][list_position([" + ", ".join(_HITSOF.values()) + "], list_max([" + ", ".join(_HITSOF.values()) + "]))] END"
_SHARE = f"1000 * len(list_intersect({keywords_sql('question')}, {keywords_sql('x.text')})) // (1 + len({keywords_sql('x.text')}))"
_ARMS = [(a, n) for a in evidence.ARMS for n in evidence.CUTS]
_EVIDENCE = f"""met AS MATERIALIZED (SELECT DISTINCT id, doc_id FROM (SELECT id, unnest(regexp_extract_all(question, '{evidence.NAME}')) AS w FROM bench_items) JOIN (SELECT doc_id, unnest(regexp_extract_all(text, '{evidence.NAME}')) AS w FROM documents) USING (w)),
pl AS MATERIALIZED (SELECT id, doc_id, text, row_number() OVER (PARTITION BY id ORDER BY a DESC, doc_id) AS lexical, row_number() OVER (PARTITION BY id ORDER BY b DESC, doc_id) AS stem, row_number() OVER (PARTITION BY id ORDER BY c DESC, doc_id) AS pair
  FROM (SELECT b.id, x.doc_id, x.text, {gq.lexical_sql('question', 'x.text')} AS a, {gq.stem_sql('question', 'x.text')} AS b, {_SHARE} AS c FROM met m JOIN bench_items b ON b.id = m.id JOIN documents x ON x.doc_id = m.doc_id)),
gw AS MATERIALIZED (SELECT id, domain, CASE WHEN gold IS NULL OR gold = '' THEN [] WHEN len(long_words) > 0 THEN long_words ELSE [lower(gold)] END AS ws FROM (SELECT id, domain, gold, list_filter({_words('lower(gold)')}, lambda w: length(w) > 3) AS long_words FROM (SELECT id, {_DOMAIN} AS domain, {_GOLD} AS gold FROM bench_items))),
hw AS (SELECT g.id, g.i, {', '.join(['max(h) AS recall'] + [f'max(h) FILTER ({a} <= {n}) AS {a}_{n}' for a, n in _ARMS])} FROM (SELECT id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM gw) g JOIN (SELECT * FROM pl) p USING (id), LATERAL (SELECT CAST(contains(lower(p.text), g.w) AS INTEGER) AS h) GROUP BY 1, 2),
ev AS MATERIALIZED (SELECT g.id, g.domain, coalesce(n.n, 0) AS ctx_n, {', '.join(f'coalesce(r.{k}, false) AS {k}' for k in ['recall'] + [f'{a}_{n}' for a, n in _ARMS])} FROM gw g
  LEFT JOIN (SELECT id, {', '.join(f'sum(coalesce({k}, 0)) / count(*) >= 0.5 AS {k}' for k in ['recall'] + [f'{a}_{n}' for a, n in _ARMS])} FROM hw GROUP BY 1) r USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM pl GROUP BY 1) n USING (id))"""
_SCORED = f"{_RUNS}, {_EVIDENCE}, scored AS MATERIALIZED (SELECT r.model, r.id, r.predicted AS answer, r.gold, CASE WHEN r.gold <> '-' THEN e.stem_15 END AS recall, CASE WHEN r.predicted = '-' THEN 0 ELSE least(e.ctx_n, 15) END AS ctx_n FROM runs r JOIN ev e USING (id))"
_HITTEXT = "(SELECT query_id, rank, text FROM hits)"

ORACLE = {
    "doc_clean_article": f"""SELECT page_id, {_squeeze("translate(regexp_replace(content, '\\(.*?\\)', '', 'g'), chr(10) || chr(34), ' ')")} AS text FROM wiki_pages""",
    "doc_clean_wiki": f"SELECT page_id, {_wiki('content')} AS text FROM wiki_pages",
    "doc_extraction_text": f"SELECT page_id, substr({_wiki('content')}, 1, 6000) AS text FROM wiki_pages",
    "doc_truncate_section": f"SELECT page_id, {_CUT} AS text FROM wiki_pages",
    "doc_clean_stats": f"SELECT source_file, pages, cleaned, CAST(r AS BIGINT) AS chars_removed, {_pct('r', 'c')} AS percent_removed FROM (SELECT source_file, count(*) AS pages, count(*) FILTER (b < a) AS cleaned, sum(a - b) AS r, sum(a) AS c FROM (SELECT source_file, coalesce(length(content), 0) AS a, coalesce(length({_CUT}), 0) AS b FROM wiki_pages) GROUP BY 1)",
    "doc_dedup_titles": "SELECT page_id, title FROM wiki_pages WHERE regexp_matches(title, '[^\\s\\p{Z}]') QUALIFY row_number() OVER (PARTITION BY title ORDER BY page_id) = 1",
    "doc_dup_counts": "SELECT title, count(*) AS n FROM wiki_pages WHERE title IS NOT NULL GROUP BY 1 HAVING n > 1",
    "doc_split_halves": "SELECT page_id, CASE WHEN row_number() OVER (ORDER BY page_id) <= (SELECT count(*) // 2 FROM wiki_pages) THEN 1 ELSE 2 END AS half FROM wiki_pages",
    "doc_title_search": "SELECT c.title, p.found FROM (SELECT DISTINCT title, substr(lower(title), 1, 5) AS k FROM chunks WHERE title IS NOT NULL) c JOIN (SELECT substr(lower(title), 1, 5) AS k, min(title) AS found FROM wiki_pages WHERE title IS NOT NULL GROUP BY 1) p USING (k)",
    "chunk_fixed256": _fixed(256, 32),
    "chunk_fixed500": _fixed(500, 50),
    "chunk_structure": f"WITH {_SECTIONS}, p AS (SELECT page_id, s, title, section, 0 AS i, body AS text FROM sec WHERE len(w) <= 196 UNION ALL {_windows('(SELECT * FROM sec WHERE len(w) > 196)', 196, 24, 'page_id, s, title, section')}) SELECT page_id, section, CAST(row_number() OVER (PARTITION BY page_id ORDER BY s, i) - 1 AS INTEGER) AS chunk_index, {_HEAD} || text AS text FROM p",
    "chunk_parents": f"WITH {_PARENTS} SELECT page_id, parent_id, section, text FROM par",
    "chunk_parent_child": f"WITH {_PARENTS} SELECT page_id, parent_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY s, m, i) - 1 AS INTEGER) AS chunk_index, {_HEAD} || text AS text FROM ({_windows('par', 98, 12, 'page_id, s, m, title, section, parent_id')})",
    "parent_expand": f"WITH {_PARENTS}, {_HITS}, pt AS (SELECT parent_id, min(text) AS ptext FROM par GROUP BY 1) SELECT query_id, rank, doc_id, coalesce(ptext, text) AS text FROM hits LEFT JOIN pt USING (parent_id) QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(CASE WHEN ptext IS NOT NULL THEN parent_id END, CAST(doc_id AS VARCHAR)) ORDER BY rank, doc_id) = 1",
    "vec_topk_cosine": f"WITH {_knn(_COS)} SELECT query_id, vec_id, rank, distance FROM top",
    "vec_topk_l2": f"WITH {_knn('list_sum(list_transform(list_zip(q.e, x.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))')} SELECT query_id, vec_id, rank, distance FROM top",
    "vec_topk_ip": f"WITH {_knn('1 - list_dot_product(q.e, x.e)')} SELECT query_id, vec_id, rank, distance FROM top",
    "vec_knn_label_accuracy": f"WITH {_knn(_COS, 'AND q.vec_id <> x.vec_id')}, n AS (SELECT query_id, x.label, count(*) AS n FROM top JOIN v x USING (vec_id) GROUP BY 1, 2), pr AS (SELECT query_id, CAST(first(label ORDER BY n DESC, label) AS VARCHAR) AS predicted FROM n GROUP BY 1), r AS (SELECT predicted, CAST(v.label AS VARCHAR) AS gold FROM pr JOIN v ON v.vec_id = query_id) {_accuracy('r', '')}",
    "vec_cosine_label_centers": "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), o AS (SELECT label, unnest(e) AS x, unnest(generate_series(1, len(e))) AS i FROM v), m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM o GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, v.label, round(list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c)) + 1e-9), 6) AS similarity FROM v JOIN m USING (label)",
    "rank_lexical": _rank(gq.lexical_sql("query", "text")),
    "rank_stem_lexical": _rank(gq.stem_sql("query", "text")),
    "vec_rerank_domain": f"WITH {_CAND}, {gq._TYPES}, st AS ({gq._type_names(v.IGNORED_SUBJECT_TYPES)}) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, text) AS INTEGER) AS rank, text, round(score, 4) AS score FROM (SELECT query_id, text, CAST({_DOMAIN_SCORE} AS DOUBLE) AS score FROM (SELECT c.*, st.types AS subject_types FROM cand c LEFT JOIN st ON st.node = c.s)) QUALIFY rank <= 10",
    "rank_two_stage_protected": f"""WITH {_CAND}, s AS (SELECT query_id, text AS cand_id, imp = 1 AS protected, {gq.lexical_sql('query', 'text')} AS a, {gq.stem_sql('query', 'text')} AS b FROM cand),
h AS (SELECT *, count(*) FILTER (protected) OVER (PARTITION BY query_id) AS held, row_number() OVER (PARTITION BY query_id, protected ORDER BY a DESC, cand_id) AS ra FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, protected ORDER BY b DESC, cand_id) AS rb FROM h WHERE protected OR ra <= greatest(0, 40 - held))
SELECT query_id, cand_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY protected DESC, b DESC, cand_id) AS INTEGER) AS place FROM k WHERE protected OR rb <= greatest(0, 15 - held)""",
    "rank_context_budget": f"WITH {_HITS}, one AS (SELECT query_id, text, min(rank) AS rank FROM hits GROUP BY 1, 2) SELECT query_id, rank, words_so_far FROM (SELECT query_id, rank, CAST(sum(len({_words('text')})) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS words_so_far FROM one) WHERE words_so_far <= 300",
    "rank_topup": f"WITH {_HITS}, k AS (SELECT query_id, rank, contains(text, 'язовир') AS kept FROM hits), n AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY kept DESC, rank) AS place FROM k) SELECT query_id, rank, kept FROM n WHERE n > 0 AND place <= greatest(3, n)",
    "rank_fallback": f"WITH {_HITS} SELECT query_id, CAST(CASE WHEN k > 0 THEN k ELSE least(2, n) END AS INTEGER) AS n, k = 0 AS fallback FROM (SELECT query_id, count(*) AS n, count(*) FILTER (contains(text, 'язовир')) AS k FROM hits GROUP BY 1)",
    "filter_selection": f"WITH {_HITS} SELECT DISTINCT query_id, md5(text) AS text_md5, true AS used FROM hits h WHERE EXISTS (SELECT 1 FROM hits z WHERE z.query_id = h.query_id AND z.text = h.text AND z.rank <= 2)",
    "relevant_names": f"WITH {gq._TEXTS}, names AS (SELECT DISTINCT split_part(s, '#', -1) AS name FROM triples WHERE starts_with(s, '{v.NS}')), parts AS (SELECT DISTINCT name, lower(part) AS part FROM (SELECT name, unnest(regexp_extract_all(name, '[А-ЯA-Z][а-яa-z]*')) AS part FROM names) WHERE length(part) >= 4) SELECT DISTINCT query_id AS text_id, name FROM texts JOIN parts ON contains(lower(text), part) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY name) <= 300",
    "cache_hit_rate": f"SELECT texts, hits, {_pct('hits', 'texts')} AS rate FROM (SELECT count(*) AS texts, count(*) FILTER (text IN (SELECT text FROM chunks WHERE chunk_index = 0 AND text IS NOT NULL)) AS hits FROM (SELECT DISTINCT text FROM chunks WHERE text IS NOT NULL))",
    "answers_join": f"WITH {_MAPPED} SELECT DISTINCT id, qid, url, correct FROM mapped",
    "url_remap": f"WITH {_MAPPED} SELECT url, count(*) AS n FROM mapped GROUP BY 1",
    "homoglyph_fix": f"WITH m AS (SELECT id, question AS q, answers AS a, correct AS c, {_mend('question')} AS question, list_transform(answers, lambda y: {_mend('y')}) AS answers, {_mend('correct')} AS correct FROM questions) SELECT DISTINCT id, question, answers, correct, question IS DISTINCT FROM q OR answers IS DISTINCT FROM a OR correct IS DISTINCT FROM c AS changed FROM m",
    "testset_build": f"WITH {_MAPPED} SELECT DISTINCT id, qid, url AS source_url, 'new' AS source_dataset, question, coalesce(['A', 'B', 'C', 'D'][list_position(list_transform(answers, lambda y: {_strip('y')}), {_strip('correct')})], '-') AS correct_answer FROM mapped",
    "testset_merge": f"SELECT id, question FROM (SELECT *, {_key('question')} AS k FROM (SELECT id, qid, question, 0 AS p FROM bench_items UNION ALL SELECT id, qid, question, 1 FROM questions)) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, id, qid) = 1",
    "text_normalise_key": f"SELECT DISTINCT id, {_key('question')} AS key FROM questions",
    "overlap_semi": f"SELECT DISTINCT id, question FROM questions WHERE {_key('question')} IN (SELECT {_key('question')} FROM questions WHERE correct IS NULL AND question IS NOT NULL)",
    "overlap_anti": f"SELECT DISTINCT id, question FROM questions WHERE question IS NULL OR {_key('question')} NOT IN (SELECT {_key('question')} FROM bench_items WHERE question IS NOT NULL)",
    "overlap_annotated": f"SELECT DISTINCT id, question, coalesce({_key('question')} IN (SELECT {_key('question')} FROM bench_items WHERE question IS NOT NULL), false) AS known FROM questions",
    "eval_errors": f"WITH {_RUNS} SELECT id, model, predicted, gold FROM runs WHERE predicted <> '' AND predicted <> gold",
    "sample_stratified": "WITH s AS (SELECT id, source_dataset, coalesce(source_dataset, 'unknown') AS st FROM bench_items), q AS (SELECT st, greatest(1, CAST(round_even(count(*) * 60 / CAST((SELECT count(*) FROM s) AS DOUBLE), 0) AS INTEGER)) AS quota FROM s GROUP BY 1) SELECT id, source_dataset FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY md5('42|' || id), id) <= quota AS own FROM s JOIN q USING (st)) ORDER BY own DESC, md5('42|' || id), id LIMIT 60",
    "batch_slice": "SELECT id, qid FROM bench_items ORDER BY id LIMIT 100 OFFSET 100",
    "resume_pending": f"WITH {_RUNS} SELECT id, qid FROM bench_items WHERE id NOT IN (SELECT id FROM runs WHERE model = 'model-a' AND predicted IS NOT NULL AND predicted <> '')",
    "merge_runs": "SELECT url, count(*) AS n, count(*) - count(DISTINCT question) AS repeated FROM questions GROUP BY 1",
    "mcq_prompt": f"SELECT id, '{v.MCQ_HEAD}' || question || chr(10) || array_to_string(list_transform(options, lambda o: o.label || ') ' || o.text || chr(10)), '') || '{v.MCQ_TAIL}' AS prompt FROM bench_items",
    "mcq_letter": "SELECT DISTINCT id, CAST(i - 1 AS INTEGER) AS i, nullif(translate(regexp_extract(reply, '(?:^|[^\\p{L}\\p{N}_])([ABCDАВСД])(?:$|[^\\p{L}\\p{N}_])', 1), 'АВСД', 'ABCD'), '') AS letter FROM (SELECT id, unnest(answers) AS reply, unnest(generate_series(1, len(answers))) AS i FROM questions)",
    "grounded_prompts": f"WITH {_HITS} SELECT query_id, md5('{v.GROUNDED_HEAD.replace(chr(39), chr(39) * 2)}' || string_agg(rank || '. ' || text, chr(10) ORDER BY rank) || '{v.GROUNDED_MIDDLE}' || query_id || '{v.GROUNDED_TAIL.replace(chr(39), chr(39) * 2)}') AS prompt_md5 FROM hits WHERE rank <= 3 GROUP BY query_id",
    "extract_year": "SELECT coalesce(nullif(regexp_extract(url, '(200[89]|201[0-9]|202[0-9])', 1), ''), 'unknown') AS year, count(*) AS n FROM questions WHERE url IS NOT NULL GROUP BY 1",
    "classify_domain": f"SELECT id, {_DOMAIN} AS domain FROM bench_items",
    "classify_bucket": f"SELECT DISTINCT id, {_TOPIC} AS topic, {_any('lower(question)', v.COUNTRY_MARKS)} AS about_country FROM questions",
    "eval_accuracy": f"WITH {_RUNS} {_accuracy('runs', 'model')}",
    "eval_slices": f"WITH {_RUNS} {_accuracy('runs', 'model, source_dataset')}",
    "eval_run_metrics": f"WITH {_SCORED} SELECT model, n, {_pct('c', 'n')} AS accuracy, {_pct('a', 'n')} AS abstention, {_pct('r', 'n')} AS recall, round(CAST(x AS DOUBLE) / n, 4) AS avg_ctx FROM (SELECT model, count(*) AS n, count(*) FILTER (answer = gold) AS c, count(*) FILTER (answer IS NULL OR answer IN ('', '-')) AS a, count(*) FILTER (recall) AS r, sum(coalesce(ctx_n, 0)) AS x FROM scored GROUP BY 1)",
    "eval_console_metrics": f"WITH {_SCORED} SELECT model, {_pct('r', 'k')} AS recall, round(x, 4) AS avg_ctx FROM (SELECT model, count(recall) AS k, count(*) FILTER (recall) AS r, avg(nullif(ctx_n, 0)) AS x FROM scored GROUP BY 1)",
    "eval_hybrid": f"WITH {_SCORED}, h AS (SELECT CASE WHEN b.answer IS NULL OR b.answer IN ('', '-') THEN coalesce(a.answer, b.answer) ELSE b.answer END AS predicted, b.gold FROM (SELECT * FROM scored WHERE model = 'model-b') b LEFT JOIN (SELECT id, answer FROM scored WHERE model = 'model-a') a USING (id)) {_accuracy('h', '')}",
    "eval_recall_proxy": f"WITH {_EVIDENCE} SELECT id, ctx_n, recall, stem_15 AS recall_15 FROM ev",
    "eval_coverage": f"WITH {_EVIDENCE}, r AS (SELECT domain, 'all' AS cut, recall FROM ev UNION ALL SELECT domain, '60', stem_60 FROM ev UNION ALL SELECT domain, '15', stem_15 FROM ev), x AS (SELECT * FROM r UNION ALL SELECT 'in_scope', cut, recall FROM r WHERE domain <> 'world_geo' UNION ALL SELECT 'all', cut, recall FROM r) SELECT domain, cut, n, covered, {_pct('(n - covered)', 'n')} AS gap_rate FROM (SELECT domain, cut, count(*) AS n, count(*) FILTER (recall) AS covered FROM x GROUP BY 1, 2)",
    "eval_survival": f"WITH {_EVIDENCE}, a AS ({' UNION ALL '.join(f"SELECT '{a}' AS arm, {a}_60 AS r60, {a}_15 AS r15 FROM ev WHERE recall" for a in evidence.ARMS)}) SELECT arm, oracle, {_pct('a', 'oracle')} AS at_60, {_pct('b', 'oracle')} AS at_15 FROM (SELECT arm, count(*) AS oracle, count(*) FILTER (r60) AS a, count(*) FILTER (r15) AS b FROM a GROUP BY 1)",
}
