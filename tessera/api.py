"""The engine's verbs over HTTP, with the standard library's server: JSON in, JSON out.

``serve(engine)`` starts it. A body that isn't a JSON object, lacks a field or names a file that isn't there
gives 400 with ``detail``, an unknown path 404, a failure 500. Work is done by Spark; the server only hands
requests over, and one engine serves all of them.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .operators import evaluation, graph
from .plans import rag
from .session import Engine
from .sources import files

#: How many rows a reply shows as a sample.
SAMPLE, NAMES = 10, 20
FACTS, PAGES = "facts", "wiki_chunks"


class BadRequest(ValueError):
    pass


def _need(body: dict, field: str, kind=str):
    if not isinstance(body.get(field), kind):
        raise BadRequest(f"{field} is missing or of another type")
    return body[field]


def _graph(engine: Engine) -> None:
    if engine.triples is None:
        raise BadRequest("no graph is loaded")


def health(engine: Engine, body: dict) -> dict:
    return {"status": "ok", "components": engine.health()}


def embed(engine: Engine, body: dict) -> dict:
    texts = [body["text"]] if isinstance(body.get("text"), str) else body.get("texts")
    if not texts:
        raise BadRequest("text or texts is needed")
    found = engine.embeddings(texts)
    return {"embeddings": found, "dimensions": len(found[0]), "device": "spark"}


def load(engine: Engine, body: dict) -> dict:
    n = engine.load(_need(body, "ttl_path"))
    return {"triples_count": n, "message": f"{n} triples"}


def process_triples(engine: Engine, body: dict) -> dict:
    _graph(engine)
    facts = engine.facts().select("text").cache()
    return {"count": facts.count(), "sample": [r.text for r in facts.orderBy("text").limit(SAMPLE).collect()]}


def ingest(engine: Engine, body: dict) -> dict:
    if body.get("ttl_path"):
        engine.load(body["ttl_path"])
    _graph(engine)
    engine.ingest_facts(FACTS)
    return {"count": engine.collections.count(FACTS), "collection": FACTS, "persisted_at": engine.store or ""}


def ingest_wiki(engine: Engine, body: dict) -> dict:
    pages = files.read_pages(engine.spark, f"{_need(body, 'data_dir')}/*.json", body.get("excluded_files", []))
    pages = pages.withColumn("page_id", F.xxhash64("source_file", "title", "content"))
    engine.ingest_pages(PAGES, pages, size=body.get("chunk_size", 500), overlap=body.get("chunk_overlap", 50))
    return {"count": engine.collections.count(PAGES), "collection": PAGES, "persisted_at": engine.store or ""}


def load_existing(engine: Engine, body: dict) -> dict:
    name = body.get("collection_name", FACTS)
    return {"collection": name, "count": engine.collections.count(name)}


def change_metric(engine: Engine, body: dict) -> dict:
    name = body.get("collection_name", PAGES)
    engine.collections.change_metric(name, _need(body, "new_metric"))
    return {"collection": name, "count": engine.collections.count(name)}


def query(engine: Engine, body: dict) -> dict:
    _graph(engine)
    local = lambda c: F.substring_index(c, "#", -1)
    hits = engine.query_facts(FACTS, _need(body, "query"), body.get("top_k", 5))
    rows = hits.select(local("subject_uri").alias("subject"), local("predicate_uri").alias("predicate"), F.coalesce("object_value", local("object_uri"), F.lit("")).alias("object"), F.col("text").alias("document"))
    found = [r.asDict() for r in rows.collect()]
    return {"results": found, "count": len(found)}


def query_wiki(engine: Engine, body: dict) -> dict:
    hits = engine.query(PAGES, _need(body, "query"), body.get("top_k", 5)).select("title", "section", "source_file", "distance_text", "preview")
    found = [r.asDict() for r in hits.collect()]
    return {"results": found, "count": len(found)}


def expand(engine: Engine, body: dict) -> dict:
    _graph(engine)
    found = [r.text for r in engine.expand(_need(body, "query")).groupBy("text").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "text").collect()]
    return {"expanded_triples": found, "count": len(found)}


def filter_facts(engine: Engine, body: dict) -> dict:
    given = _need(body, "triples", list)
    found = [r.text for r in engine.select(given, _need(body, "query")).collect()] if given else []
    return {"filtered": found, "original_count": len(given), "filtered_count": len(found)}


def generate(engine: Engine, body: dict) -> dict:
    prompts = engine.spark.createDataFrame([("1", _need(body, "prompt"))], "query_id string, prompt string")
    row = engine.generate(prompts).first()
    if row.error:
        raise RuntimeError(row.error)
    return {"response": row.reply}


def _question(engine: Engine, body: dict):
    return engine.spark.createDataFrame([("1", _need(body, "query"), [], None)], "query_id string, question string, options array<struct<label:string,text:string>>, correct_answer string")


def kg_rag(engine: Engine, body: dict) -> dict:
    _graph(engine)
    timings: dict = {}
    row = rag.answer_from_graph(_question(engine, body), engine.triples, engine.embed, engine.model, selector=engine.selector, timings=timings).first()
    return {"response": row.reply, "timings": {f"{k}_s": s for k, s in {**timings, "total": round(sum(timings.values()), 2)}.items()}}


def vector_rag(engine: Engine, body: dict) -> dict:
    timings: dict = {}
    clock = rag.Clock(timings)
    row = rag.answer_from_hits(_question(engine, body), engine.collections.read(PAGES), engine.embed, engine.model, engine.collections.metric(PAGES)).first()
    clock("total")
    return {"response": row.reply, "timings": {f"{k}_s": s for k, s in timings.items()}}


def snapshot(engine: Engine, body: dict) -> dict:
    if body.get("ttl_path"):
        engine.load(body["ttl_path"])
    _graph(engine)
    n = {r.what: r.n for r in engine.snapshot().collect()}
    names = graph.snapshot_names(engine.triples)
    schema = [f"{r.what} {r.name}" for r in names.filter("what <> 'instance'").orderBy("what", "name").limit(NAMES).collect()]
    return {"classes": n["classes"], "properties": n["object_properties"] + n["datatype_properties"], "instances": n["instances"], "schema_turtle_preview": "\n".join(schema), "sample_instances": [r.name for r in names.filter("what = 'instance'").orderBy("name").limit(NAMES).collect()]}


def process_batch(engine: Engine, body: dict) -> dict:
    _graph(engine)
    pages = _need(body, "pages", list)
    df = engine.spark.createDataFrame([(p.get("title"), p.get("content")) for p in pages], "title string, content string")
    added, bad = engine.extract(df, engine.model)
    n, errors = {r.title: r.triples for r in added.collect()}, {r.title: r.error for r in bad.collect()}
    return {"results": [{"page_title": p.get("title"), "triples_added": n.get(p.get("title"), 0), "validation_errors": [errors[p.get("title")]] if p.get("title") in errors else [], "success": p.get("title") not in errors} for p in pages]}


def evaluate(engine: Engine, body: dict) -> dict:
    """Accuracy of an answer column of a file of records, one a line; a key ``model_answers.x`` is looked up in the map."""
    key = _need(body, "answer_key")
    df = engine.spark.read.json(_need(body, "input_file"))
    if key.split(".")[0] not in df.columns:
        raise BadRequest(f"no column {key}")
    rows = df.select("question", F.col(key).alias("predicted"), F.col("correct_answer").alias("gold"))
    one = evaluation.accuracy(rows).first()
    wrong = [{"question": r.question, "predicted": r.predicted, "correct": r.gold} for r in evaluation.errors(rows).orderBy("question").limit(NAMES).collect()]
    return {"label": body.get("label", ""), "accuracy": one.accuracy, "total": one.total, "correct": one.correct, "errors": wrong}


ROUTES = {
    ("GET", "/api/health"): health,
    ("POST", "/api/embeddings/embed"): embed,
    ("POST", "/api/rdf/load"): load,
    ("POST", "/api/rdf/process-triples"): process_triples,
    ("POST", "/api/vector-store/ingest"): ingest,
    ("POST", "/api/vector-store/ingest-wiki"): ingest_wiki,
    ("POST", "/api/vector-store/load-existing"): load_existing,
    ("POST", "/api/vector-store/change-metric"): change_metric,
    ("POST", "/api/vector-store/query"): query,
    ("POST", "/api/vector-store/query-wiki"): query_wiki,
    ("POST", "/api/sparql/expand"): expand,
    ("POST", "/api/reasoning/filter"): filter_facts,
    ("POST", "/api/generation/generate"): generate,
    ("POST", "/api/pipelines/kg-rag"): kg_rag,
    ("POST", "/api/pipelines/vector-rag"): vector_rag,
    ("POST", "/api/ontology/snapshot"): snapshot,
    ("POST", "/api/ontology/process-batch"): process_batch,
    ("POST", "/api/evaluation/evaluate"): evaluate,
}


def answered(engine: Engine, method: str, path: str, raw: bytes) -> tuple[int, dict]:
    """(status, reply) of a request."""
    route = ROUTES.get((method, path.split("?")[0]))
    if route is None:
        return 404, {"detail": "no such path"}
    try:
        body = json.loads(raw or b"{}")
        if not isinstance(body, dict):
            raise BadRequest("the body must be an object")
        return 200, route(engine, body)
    except (BadRequest, ValueError, FileNotFoundError, KeyError, AnalysisException) as e:
        return 400, {"detail": str(e)[:500]}
    except Exception as e:  # noqa: BLE001
        return 500, {"detail": str(e)[:500]}


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet; port 0 takes a free one."""
    lock = Lock()  # the loaded graph is the engine's, so requests go one after the other

    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            with lock:
                status, reply = answered(engine, self.command, self.path, raw)
            data = json.dumps(reply, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> None:
    server(engine, host, port).serve_forever()
