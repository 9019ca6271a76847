import numpy as np
from pyspark.sql import functions as F

from tessera.llm import splitting as S
from tests.llm.conftest import clashing, pseudo_words

ITEM = "src string, item_id bigint, title string, section string, text string"
L = S.Limits()


def text_of(rnd, n, marks=True):
    out = []
    for i, w in enumerate(pseudo_words(rnd, n)):
        out.append(w + (rnd.choice([". ", ".\n\n", ", "]) if marks and rnd.random() < 0.15 else rnd.choice([" ", "\u00a0", "  "])))
    return "".join(out)


def pieces(spark, rows):
    df = spark.createDataFrame(rows, ITEM).withColumn("oversized", F.lit("clash"))
    out = {}
    for r in S.split_items(clashing(df)).collect():
        out.setdefault((r.src, r.item_id), []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_index) for k, v in out.items()}


def test_properties(spark, rnd):
    rows = []
    for i in range(60):
        parts = [text_of(rnd, rnd.choice([3, 150, 196, 197, 500, 900]), rnd.random() < 0.7)]
        for k in range(rnd.randint(0, 3)):
            parts.append(f"== Раздел {k} ==\n" + text_of(rnd, rnd.choice([1, 100, 400])))
        rows.append(("page", i, f"t{i}", None, "\n".join(parts)))
    got = pieces(spark, rows)
    for src, i, title, _, text in rows:
        own, words = got[src, i], text.split()
        big = len(text) > 2000 or len(words) > 196
        assert all(r.oversized == big and r.title == title for r in own) and [r.piece_index for r in own] == list(range(len(own))) and own[0].pieces == len(own)
        if not big:
            assert len(own) == 1 and own[0].text == text
            continue
        by_section = {}
        for r in own:
            assert len(r.text) <= 2000 and len(r.text.split()) <= 196 and r.words == len(r.text.split())
            by_section.setdefault(r.section, []).append(r.text.split())
        for name, runs in by_section.items():
            whole = list(runs[0])
            for a, b in zip(runs, runs[1:]):
                assert a[-24:] == b[:24]
                whole += b[24:]
            body = text.split("== Раздел")[0] if name is None else text.split(f"== {name} ==")[1].split("== Раздел")[0]
            assert whole == body.split()


def test_natural_ends(spark, rnd):
    sentence = " ".join(pseudo_words(rnd, 11)) + " край. "
    got = pieces(spark, [("page", 1, "t", None, sentence * 60)])["page", 1]
    assert len(got) > 3 and all(r.text.endswith("край.") for r in got)


def test_doubling_is_the_chain(rnd):
    for n in (1, 5, 300):
        following = np.array([min(n, i + rnd.randint(1, 9)) for i in range(n)])
        first = np.array([0, n // 2])
        want = np.zeros(n, bool)
        for i in first:
            while i < n:
                want[i] = True
                i = following[i]
        assert (S.reached(first, following) == want).all()


def test_edges(spark):
    rows = [
        ("page", 1, None, None, None), ("page", 2, None, None, ""), ("page", 3, "t", None, " \u00a0" * 1500), ("page", 4, "t", None, "х" * 9000), ("page", 5, "t", "s", ("ю" * 300 + " ") * 100), ("page", 6, "t", None, "== Само ==\n" + "а " * 300 + "== Празен =="),
        ("page", 7, "t", None, "дума " * 200_000), ("page", None, "t", None, "x"), ("page", 8, "t", None, "a" * 2000), ("page", 9, "t", None, "a" * 2001), ("page", 10, "t", None, "а " * 196), ("page", 11, "t", None, "а " * 197),
    ]
    got = pieces(spark, rows)
    assert ("page", 1) not in got and got["page", 2][0].text == "" and got["page", 3][0].oversized and got["page", 3][0].text == ""
    assert "".join(r.text for r in got["page", 4][:1]) == "х" * 2000 and all(len(r.text) <= 2000 for r in got["page", 4] + got["page", 5])
    assert got["page", 5][0].section == "s" and [r.section for r in got["page", 6]][-1] == "Празен" and len(got["page", 7]) > 1000
    assert [got["page", i][0].oversized for i in (8, 9, 10, 11)] == [False, True, False, True]
    assert S.split_items(spark.createDataFrame([], ITEM)).count() == 0
    assert len(pieces(spark, [("chunk", 1, "t", None, "x"), ("chunk", 1, "t", None, "x")])["chunk", 1]) == 2


def test_a_long_stretch_between_equal_signs_is_text(spark, rnd):
    words = " ".join(pseudo_words(rnd, 150))
    got = pieces(spark, [("page", 1, "t", None, f"== {words} == {words} == Край == {words}")])["page", 1]
    assert {r.section for r in got} == {None, "Край"} and sum(r.text.count("==") for r in got if r.section is None) >= 2
    assert S._sections("== " + "а" * 200 + " == x", np.array([0, 3]), None, 200)[1][0] == "а" * 200
    assert len(S._HEADING.findall("== " * 20_000)) == 0


def test_pieces_against_a_walk(spark, rnd):
    # each cut followed one after the other, with the same legal ends
    text = text_of(rnd, 3000)
    got = [r.text.split() for r in pieces(spark, [("page", 1, "t", None, text)])["page", 1]]
    words, at, want = text.split(), 0, []
    codes = S._codes(text)
    starts, ends = S.spans(codes)
    level = S._natural(codes, starts, ends)
    while True:
        most = at + 1
        while most < len(words) and most - at < 196 and ends[most] - starts[at] <= 2000:
            most += 1
        if most < len(words):
            last = lambda least: max((k + 1 for k in range(at, most) if level[k] >= least), default=0)
            paragraph, sentence = last(2), last(1)
            most = paragraph if paragraph > max(at + 24, at + (most - at) // 2) else sentence if sentence > at + 24 else most
        want.append(words[at:most])
        if most == len(words):
            break
        at = max(most - 24, at + 1)
    assert got == want
