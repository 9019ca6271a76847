import json

from tessera.llm import copies as C
from tests.llm.conftest import clashing

PAGE, RECORD = "page_id bigint, title string, content string", "page_id bigint, record string"


def test_edges(spark):
    pages = spark.createDataFrame([
        (5, "Рила", "Пещерата е дълга 5 м."), (2, " РИЛА!", "пещерата\n== е ==  ДЪЛГА, 5 М"), (3, "Рила", "Пещерата е дълга 6 м."), (4, None, "Пещерата е дълга 5 м."), (6, None, "Пещерата е дълга 5 м."),
        (7, "x", None), (8, "x", None), (9, "y", " … "), (10, "y", "—"), (11, "Рила", "Пещерата е дълга 5 м." * 20000), (12, "РИЛА", "Пещерата е дълга 5 м.\n" * 20000), (13, "й", "ё"), (14, "и\u0306", "Ё"), (2, " РИЛА!", "пещерата\n== е ==  ДЪЛГА, 5 М"),
    ], PAGE)
    records = spark.createDataFrame([
        (20, json.dumps({"content": "Пещерата е дълга 5 м", "title": "рила", "z": 1})), (21, '{"title": "Рила", "content": "Пещерата е дълга 5 м"'), (22, json.dumps(["Рила"])), (23, None), (24, json.dumps({"title": 3, "content": "x"})), (25, "null"),
    ], RECORD)
    keys = C.page_keys(clashing(pages), clashing(records))
    assert {tuple(r) for r in C.copies(keys).collect()} == {(2, 5), (2, 20), (11, 12), (13, 14)}
    assert C.collisions(keys).count() == 0
    assert {(r.page_id, r.copies) for r in C.collapsed(pages.filter("page_id IN (5, 3, 20)"), records).collect()} == {(5, 2), (3, 1)}
    empty = C.page_keys(pages.limit(0), records.limit(0))
    assert C.copies(empty).count() == 0 and C.copy_sets(empty).count() == 0


def test_hot_set_and_brute_force(spark, rnd):
    rows = [(i, "T", "А-б в" if i % 3 == 0 else f"{'аб'[i % 2]} {i % 50}") for i in range(3000)]
    found = {tuple(r) for r in C.copies(C.page_keys(spark.createDataFrame(rows, PAGE).repartition(6))).collect()}
    first, want = {}, set()
    for i, t, c in rows:
        key = (t.lower(), "".join(x for x in c.lower() if x.isalnum()))
        if key in first:
            want.add((first[key], i))
        first.setdefault(key, i)
    assert found == want


def test_guard_keeps_colliding_hashes_apart(spark):
    keys = spark.createDataFrame([(1, bytearray(b"h"), 1, 5), (2, bytearray(b"h"), 2, 5), (3, bytearray(b"h"), 1, 5)], C.KEYS)
    assert {tuple(r) for r in C.copies(keys).collect()} == {(1, 3)} and C.collisions(keys).first()["keys"] == 2


def test_pages_without_copies_are_counted(spark):
    pages = spark.createDataFrame([(1, "Рила", "пет"), (2, "РИЛА", "Пет."), (3, None, "пет"), (4, None, "пет"), (5, "x", None), (6, "x", " … "), (6, "x", " … "), (-7, None, None), (None, "Рила", "пет")], PAGE)
    records = spark.createDataFrame([(20, json.dumps({"title": "рила", "content": "пет"})), (21, json.dumps({"title": "рила", "content": "  \n"})), (22, json.dumps({"content": "пет"})), (23, "{"), (24, None), (25, "[]")], RECORD)
    keys = C.page_keys(clashing(pages), clashing(records), lone=True)
    assert sorted(map(tuple, C.counted(keys).collect())) == [(-7, 1), (1, 3), (3, 1), (4, 1), (5, 1), (6, 1), (21, 1), (22, 1)]
    assert C.counted(C.page_keys(pages.limit(0), records.limit(0), lone=True)).count() == 0


def test_all_pages_are_in_the_query(spark, data):
    from tessera.llm.queries import QUERIES

    ids = {r.page_id for r in QUERIES["p1_pages"](spark, data).collect()}
    copies = {r.copy_id for r in QUERIES["p1_found"](spark, data).collect()}
    pages = {r.page_id for r in spark.read.parquet(f"{data}/wiki_pages.parquet").select("page_id").collect()}
    assert pages <= ids | copies and not ids & copies


def test_query(spark, data, same_as_sql):
    from tessera.llm.queries import ORACLE, QUERIES

    for name in ORACLE:
        same_as_sql(QUERIES[name], ORACLE[name])
