import itertools

from tessera.llm import lookalikes as L
from tests.llm.conftest import clashing

Q = "id string, question string, answers array<string>"


def test_pairs(spark):
    a = ["едно", "две", "три", "4"]
    rows = [
        ("1", "Коя е река Арда?", a), ("2", "Koя e  peкa\u00a0Apдa?", a), ("3", "К\u200bоя е река\u3000Арда？ ", a), ("4", "Коя е река арда?", a), ("5", "Коя е река Арда!", a), ("6", "Коя е река Арда?", ["едно", "две", "тpи\u00ad", "４"]),
        ("7", None, a), ("8", None, a), ("9", "Коя е река Арда?", [*a[:3], None]), ("10", "Коя е река Арда?", None), ("11", "\u200b Коя \ufeff е река Арда?", a), ("1", "Коя е река Арда?", a), ("12", "Йод и\u0306", a), ("13", "Йод й", a), ("14", "Иод и", a), ("15", "", a), ("16", "\u200b", a),
    ]
    df = clashing(spark.createDataFrame(rows, Q))
    found = {tuple(r) for r in L.alike_questions(L.question_rows(df)).collect()}
    same = ["1", "2", "3", "6", "11"]
    want = {tuple(sorted(p)) for p in itertools.combinations(same, 2)} | {("12", "13"), ("15", "16")}
    assert found == want
    forms = {r.id: (r.question, tuple(r.answers or ())) for r in L.one_form_questions(L.question_rows(df)).collect()}
    assert len({forms[i] for i in same}) == 1 and forms["1"][0] == "Коя е река Арда?" and forms["4"] != forms["1"] and forms["7"][0] is None
    assert L.alike_questions(L.question_rows(df.limit(0))).count() == 0


def test_forms_against_skeletons(spark, rnd):
    base = ["аероха", "ТЕС", "GPS", "km", "Сорт", "хор2", "„река“", "centr", "ОО", "m3/s"]
    swap = {c: g for g in L.ALIKE for c in g}
    words = []
    for _ in range(3000):
        w = "".join(rnd.choice(swap.get(c, c)) if rnd.random() < 0.4 else c for c in rnd.choice(base))
        if rnd.random() < 0.2:
            w += rnd.choice("\u200b\ufeff\u00ad")
        words.append((w,))
    got = {r.word: r.form for r in L.forms(spark.createDataFrame(words * 2, "word string").repartition(5)).collect()}
    assert set(got) == {w for w, in words}
    for w, f in got.items():
        assert L.skeleton(w) == L.skeleton(f)
    classes = {}
    for w, f in got.items():
        assert classes.setdefault(L.skeleton(w), f) == f


def test_automaton_costs():
    t = L.Trie()
    for w in ("река", "реки", "рекичка"):
        t.add(w, 1)
    assert [x[2] for x in t.spellings("peкa")] == ["река"] and t.spellings("рака") == []
    assert {(c, w) for c, _, w in t.spellings("рек", 1)} == {(1, "река"), (1, "реки")} and (1, "река") in {(c, w) for c, _, w in t.spellings("реека", 1)}
    assert L.by_table("TЕСT") == L.by_table("ТECТ") == "ТЕСТ" and L.by_table("GРЅ") == "GPS"
    assert L.forms is not None and L.composed("ａ\u200b") == "a"


def test_the_vocabulary_decides_between_scripts(spark, monkeypatch):
    # CO is made of look-alikes alone: most texts spell it in Latin, the table alone would give Cyrillic
    texts = ["газът CO тук", "CO и вода", "мярка CO", "газът С​О тук", "газът CО тук", "сос от Сорос", "coс", "сос"]
    rows = spark.createDataFrame([(str(i), t, ["а", "б", "в", "г"]) for i, t in enumerate(texts * 2)], Q).repartition(3)
    want = {"газът CO тук", "CO и вода", "мярка CO", "сос от Сорос", "сос"}
    assert L.by_table("CO") == "СО"
    got = sorted(tuple(map(str, r)) for r in L.one_form_questions(L.question_rows(rows)).collect())
    assert {q for _, q, _ in got} == want
    pairs = sorted(L.alike_questions(L.question_rows(rows)).collect())
    monkeypatch.setattr(L, "SPELLINGS", 0)  # spellings are joined to the texts instead
    assert sorted(tuple(map(str, r)) for r in L.one_form_questions(L.question_rows(rows)).collect()) == got
    assert sorted(L.alike_questions(L.question_rows(rows)).collect()) == pairs and len(pairs) > 8


def test_table_is_the_only_clear_spelling(rnd):
    # a letter of one script only settles a word: no other clear word has its skeleton
    swap = {c: g for g in L.ALIKE for c in g}
    for w in ("река", "centr", "Αθήνα", "GPS", "Хибини", "ёж"):
        for _ in range(200):
            mixed = "".join(rnd.choice(swap.get(c, c)) for c in w)
            assert not L.unclear(L.skeleton(mixed)) and L.by_table(mixed) == w and (not L.clear(mixed) or mixed == w)
    assert L.unclear("со") and not L.unclear("12") and not L.unclear("соб")


def test_copies_stored_alike_never_meet(spark):
    rows = [(f"{i:05}", "Коя е река Арда?", ["а", "б", "в", "г"]) for i in range(3000)] + [("x", "Koя е река Арда?", ["а", "б", "в", "г"])]
    got = L.alike_questions(L.question_rows(spark.createDataFrame(rows, Q).repartition(4)))
    assert got.count() == 3000 and got.filter("id_b <> 'x'").count() == 0
