import http.client
import json
import threading

import pytest

from tessera import __main__ as cli
from tessera import api
from tessera.session import Engine
from tests.test_sources import TTL


@pytest.fixture(scope="module")
def call(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")))
    server = api.server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None, method="POST"):
        c = http.client.HTTPConnection(*server.server_address, timeout=300)
        c.request(method, path, None if body is None else body if isinstance(body, str) else json.dumps(body))
        r = c.getresponse()
        return r.status, json.loads(r.read())

    yield call
    server.shutdown()


def test_all_routes(spark, call, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    assert call("/api/health", method="GET")[1]["components"]["graph"] is False
    assert call("/api/rdf/process-triples", {})[0] == 400 and call("/api/none", {})[0] == 404 and call("/api/rdf/load", "[1]")[0] == 400 and call("/api/rdf/load", "{")[0] == 400
    assert call("/api/rdf/load", {"ttl_path": str(tmp_path / "none.ttl")})[0] == 400
    assert call("/api/rdf/load", {"ttl_path": str(tmp_path / "a.ttl")}) == (200, {"triples_count": 16, "message": "16 triples"})
    status, got = call("/api/rdf/process-triples", {})
    assert status == 200 and got["count"] == 8 or got["count"] > 5 and len(got["sample"]) <= 10
    status, got = call("/api/embeddings/embed", {"texts": ["a", "b"]})
    assert status == 200 and len(got["embeddings"]) == 2 and got["dimensions"] == 64 and call("/api/embeddings/embed", {})[0] == 400
    status, got = call("/api/vector-store/ingest", {})
    assert status == 200 and got["collection"] == "facts" and got["count"] > 5
    status, got = call("/api/vector-store/query", {"query": "Колко е висок Вихрен", "top_k": 3})
    assert status == 200 and got["count"] == 3 and any(r["object"] == "2914" for r in got["results"])
    (tmp_path / "fetched-a.json").write_text(json.dumps([{"title": "Мусала", "content": "Мусала е връх в Рила. " * 30, "language": "bg"}]))
    assert call("/api/vector-store/ingest-wiki", {"data_dir": str(tmp_path), "chunk_size": 50, "chunk_overlap": 5})[1]["count"] > 1
    status, got = call("/api/vector-store/query-wiki", {"query": "Мусала", "top_k": 2})
    assert status == 200 and got["count"] == 2 and got["results"][0]["title"] == "Мусала"
    assert call("/api/vector-store/load-existing", {"collection_name": "facts"})[1]["count"] > 5
    assert call("/api/vector-store/change-metric", {"collection_name": "wiki_chunks", "new_metric": "l2"})[0] == 200 and call("/api/vector-store/change-metric", {"new_metric": "dot"})[0] == 400
    status, got = call("/api/sparql/expand", {"query": "Колко е висок връх Вихрен?"})
    assert status == 200 and "Вихрен надморска Височина 2914 Метър" in got["expanded_triples"]
    status, got = call("/api/reasoning/filter", {"triples": ["Вихрен е тип Връх", "Мусала държава България"], "query": "Какво е Вихрен"})
    assert status == 200 and (got["original_count"], got["filtered"]) == (2, ["Вихрен е тип Връх"])
    assert call("/api/generation/generate", {"prompt": "вода\nВъпрос: x\nA) вода\nB) въздух"}) == (200, {"response": "A"})
    status, got = call("/api/pipelines/kg-rag", {"query": "Къде е Мусала?"})
    assert status == 200 and got["response"] and got["timings"]["total_s"] > 0
    assert call("/api/pipelines/vector-rag", {"query": "Къде е Мусала?"})[0] == 200
    status, got = call("/api/ontology/snapshot", {})
    assert status == 200 and got["instances"] == 3 and "Мусала" in got["sample_instances"]
    status, got = call("/api/ontology/process-batch", {"pages": [{"title": "Ботев", "content": "Ботев е връх."}]})
    assert status == 200 and got["results"][0]["page_title"] == "Ботев" and not got["results"][0]["success"]
    (tmp_path / "runs.jsonl").write_text("\n".join(json.dumps({"question": str(i), "correct_answer": "A", "model_answers": {"m": "AB"[i % 2]}}) for i in range(4)))
    status, got = call("/api/evaluation/evaluate", {"input_file": str(tmp_path / "runs.jsonl"), "answer_key": "model_answers.m", "label": "x"})
    assert status == 200 and (got["accuracy"], got["total"], got["correct"], len(got["errors"])) == (50.0, 4, 2, 2)
    assert call("/api/evaluation/evaluate", {"input_file": str(tmp_path / "runs.jsonl"), "answer_key": "none"})[0] == 400
    assert len(api.ROUTES) == 18


def test_command_line(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "q.jsonl").write_text(json.dumps({"question": "Къде е Мусала?"}))
    (tmp_path / "runs.jsonl").write_text("\n".join(json.dumps({"question": str(i), "correct_answer": "A", "own": "AB"[i % 2], "source_dataset": "s"}) for i in range(4)))
    assert "merged_labels" in cli.main(["curate", str(tmp_path / "a.ttl"), "--out", str(tmp_path / "g"), "--dry-run"], spark) and not (tmp_path / "g").exists()
    cli.main(["curate", str(tmp_path / "a.ttl"), "--out", str(tmp_path / "g")], spark)
    assert (tmp_path / "g").exists()
    assert "type_name" in cli.main(["subgraph", str(tmp_path / "a.ttl"), str(tmp_path / "q.jsonl")], spark)
    assert cli.main(["evaluate", str(tmp_path / "runs.jsonl"), "own", "--by", "source_dataset"], spark).splitlines()[1].split() == ["s", "4", "2", "50.0"]
