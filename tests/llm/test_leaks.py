import time

from tessera.llm import leaks as L
from tests.llm.conftest import clashing, pseudo_words


def setup(rnd, n=40, size=40):
    vocabulary = pseudo_words(rnd, 3000)
    return {f"i{k}": [rnd.choice(vocabulary) for _ in range(size)] for k in range(n)}, vocabulary


def test_planted(spark, rnd):
    items, vocabulary = setup(rnd)
    noise = lambda n: pseudo_words(rnd, n, "абвгдklmn")
    docs, want = [], set()

    def plant(words, hit, item):
        d = len(docs)
        docs.append((d, " ".join(noise(rnd.randint(0, 60)) + words + noise(rnd.randint(0, 60)))))
        if hit:
            want.add((d, item))

    for k, (i, w) in enumerate(items.items()):
        plant(w[5:17], True, i)  # twelve words
        plant(w[5:16], False, i)  # eleven
        plant(w[3:9] + noise(1) + w[10:15], True, i)  # one of twelve replaced
        plant(w[0:8] + w[9:20] + noise(1) + w[20:40], True, i)  # left out and added
        plant([x.upper() + "," for x in w], True, i)
        shuffled = list(w)
        rnd.shuffle(shuffled)
        plant(shuffled, False, i)
        every = [x if n % 4 else noise(1)[0] for n, x in enumerate(w)]
        plant(every, False, i)
    docs += [(9000, None), (9001, ""), (None, " ".join(items["i0"])), (9002, " ".join(noise(20000) + items["i1"])), (9003, " ".join(items["i2"] + noise(3) + items["i3"])), (9003, " ".join(items["i2"] + noise(3) + items["i3"]))]
    want |= {(9002, "i1"), (9003, "i2"), (9003, "i3")}
    d = clashing(spark.createDataFrame(docs, "doc_id bigint, text string")).withColumnRenamed("kind", "item_id")
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [("short", "една къса"), ("null", None), (None, "x")], "item_id string, question string")
    got = {(r.doc_id, r.item_id) for r in L.leaked(d, q).filter("kind = 'verbatim'").collect()}
    assert got == want
    assert L.leaked(d.limit(0), q).count() == 0 and L.leaked(d, q.limit(0)).count() == 0


def test_templates_and_blocks(spark, rnd, monkeypatch):
    text = "Пътеводител на {a} твърди, че островни градини до {b} траят {n} ридове, при което мостови седла от {c} дават {m} единици, накрая {a} получава слънчеви бентове"
    item = text.format(a="Литисе", b="Зира", n=73, c="Зесиси", m="6,4")
    plain = " ".join(w for w in item.split() if w.isalpha() and w.islower())
    q = spark.createDataFrame([("x", item), ("y", plain + " и още думи за втория въпрос, който стои отделно от първия")], "item_id string, question string")
    docs = spark.createDataFrame([(1, text.format(a="Мехист", b="Дани", n=12, c="Рега", m="9,1")), (2, item.upper())], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in L.leaked(docs, q).collect()}
    assert (1, "x", "template") in got and (2, "x", "verbatim") in got
    monkeypatch.setattr(L, "BLOCK", 1)
    assert {(r.doc_id, r.item_id) for r in L.leaked(docs, q).collect() if r.kind == "verbatim"} >= {(2, "x")}


def test_later_stretches_and_longer_names_are_templates(spark):
    head, tail = "който е първи в реда", "пътеводител {a} твърди островни {b} траят точно {n} ридове мостови {c} дават {m} единици слънчеви {d} накрая бентове {e} край"
    own, other = dict(a="Литисе", b="Зира", n=73, c="Зесиси", m=64, d="Тонза", e="Мира"), dict(a="Мехист", b="Дани", n=12, c="Рега", m=91, d="Лодо", e="Сума")
    items = [("x", f"{head} обикновено {tail.format(**own)}"), ("y", "остров е друго място и градини има там при седла но единици не са бентове нито ридове")]
    docs = [
        (1, f"{head} остров {tail.format(**other)}"),  # one ordinary word changed, then other numbers and names
        (2, tail.format(**{**other, "b": "Дани Рано", "d": "Лодо Дола Тип"})),  # longer names
        (3, f"{head} остров " + " ".join(tail.format(**other).split()[:11])),  # too short
    ]
    q = spark.createDataFrame(items, "item_id string, question string")
    got = {tuple(r) for r in L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), q).collect()}
    assert got == {(d, "x", "template", len(tail.split()), 7) for d in (1, 2)}


def test_a_contradiction_ends_a_stretch_only(spark):
    text = "{a} има стари {a} мостове тук {b} и нови {c} кули стоят {d} високи хълма {e} две дълбоки {f} реки"
    names = dict(b="Дани", c="Рега", d="Тонза", e="Лодо", f="Сума")
    q = spark.createDataFrame([("x", text.format(a="Литисе", b="Зира", c="Мира", d="Вено", e="Гуса", f="Пило")), ("n", "Мехист Рано " + " ".join(names.values()))], "item_id string, question string")
    doc = text.replace("{a}", "Мехист", 1).format(a="Рано", **names)
    got = L.leaked(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), q).collect()
    assert [tuple(r) for r in got] == [(1, "x", "template", len(text.split()) - 1, 6)]


def test_a_stock_opening_of_many_items(rnd, monkeypatch):
    vocabulary = pseudo_words(rnd, 4000)
    opening = rnd.sample(vocabulary, 8)
    items = [(f"i{k}", " ".join(opening + [rnd.choice(vocabulary) for _ in range(30)])) for k in range(2400)]
    docs = [" ".join([rnd.choice(vocabulary) for _ in range(100)] + opening + [rnd.choice(vocabulary) for _ in range(200)]) for _ in range(100)]
    docs[5] += " " + " ".join(items[77][1].split()[3:20])
    docs[6] = docs[6].replace(" ".join(opening), " ".join(items[78][1].split()[:10] + ["друга"] + items[78][1].split()[11:20]))
    ready = L.prepared(items)
    began = time.perf_counter()
    got = set(L.find(range(100), docs, ready, L._Vocabulary(ready)))
    assert time.perf_counter() - began < 8 and {r[:3] for r in got} == {(5, "i77", "verbatim"), (6, "i78", "verbatim")}
    monkeypatch.setattr(L, "MEETINGS", 500)  # in parts, also of the items
    few = [docs[k] for k in (4, 5, 6)]
    assert {r[1:] for r in L.find(range(3), few, ready, L._Vocabulary(ready))} == {r[1:] for r in got}


def test_a_word_of_several_tokens_is_one_change(rnd):
    words = pseudo_words(rnd, 12)
    for own, other in ((words[:6] + ["14,1"] + words[6:11], words[:6] + ["друго"] + words[6:11]), (words, words[:6] + ["по-малко-от"] + words[7:])):
        ready = L.prepared([("x", " ".join(own))])
        got = list(L.find([1], ["начало " + " ".join(other) + " край"], ready, L._Vocabulary(ready)))
        assert got == [(1, "x", "verbatim", 12, 1)]


def test_items_go_in_blocks_of_bounded_size(monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 10)
    assert [len(b) for b in L._blocks([("a", "x" * 6), ("b", "x" * 4), ("c", "x" * 30), ("d", "x")])] == [2, 1, 1]


def test_reparameterised_items_in_a_corpus(spark, rnd):
    # a hundred items of which each stands once with other names and numbers among two thousand documents
    lower, names = pseudo_words(rnd, 2000), [w.capitalize() for w in pseudo_words(rnd, 400, "бвгджзклмнпрстаеиоу") if len(w) > 3]

    def make(fill):
        return " ".join(fill(w) if w in ("N", "Z") else w for w in shape)

    items, docs, want = [], [], set()
    for k in range(100):
        shape = [rnd.choice(lower) for _ in range(24)]
        for at in rnd.sample(range(24), 5):
            shape[at] = rnd.choice("NZ")
        fresh = lambda w: rnd.choice(names) if w == "N" else str(rnd.randint(10, 9999))
        items.append((f"i{k}", make(fresh)))
        docs.append((k, " ".join(rnd.choice(lower) for _ in range(30)) + " " + make(fresh) + " " + " ".join(rnd.choice(lower) for _ in range(30))))
        want.add((k, f"i{k}"))
    docs += [(1000 + k, " ".join(rnd.choice(lower + names) for _ in range(80))) for k in range(2000)]
    q = spark.createDataFrame(items, "item_id string, question string")
    got = {(r.doc_id, r.item_id) for r in L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), q).collect()}
    assert len(got & want) >= 95 and len(got - want) == 0
