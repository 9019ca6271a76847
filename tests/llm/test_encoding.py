import random

import pytest

from tessera.llm import encoding as E
from tests.llm.conftest import clashing, pseudo_words

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def coder():
    return E.encoder(f"{E.tokenizer_folder()}/byte_bpe_50k.tiktoken", PATTERN)


def test_any_cut_is_repaired(coder):
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "'re", "r", "e", "1", "2", ".", "й", "👩‍🔬", " x", "ll", "\t", "…", "<|endoftext|>", "'ve"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60)))
        at = [0, *sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 6))), len(text)]
        assert E.joined([coder.encode(text[a:b]) for a, b in zip(at, at[1:])], coder) == coder.encode(text)[0]


def test_long_repairs(coder):
    for text in (" " * 5000 + "x", "a" * 3000, "'" * 500 + "re", "\n \n" * 700, "1" * 900 + "a"):
        for step in (7, 64, 333):
            assert E.joined([coder.encode(text[i : i + step]) for i in range(0, len(text), step)], coder) == coder.encode(text)[0]


def test_chunks_are_shared_and_complete(rnd):
    common = " ".join(pseudo_words(rnd, 2000))
    a, b = E.chunks("едно " + common), E.chunks(" ".join(pseudo_words(rnd, 300)) + common)
    assert len(set(a) & set(b)) > 3 and "".join(a) == "едно " + common and max(map(len, a)) <= E.LONGEST


def test_documents(spark, rnd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.tokenizer_folder()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    shared = " ".join(pseudo_words(rnd, 1500))
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>it's '"), (5, shared), (6, "x " + shared), (7, shared), (8, "дълъг\n" * 60_000), (9, "\u200b\ufeff"), (5, shared), (None, "x"), (10, "a\r\n\r\n  b")]
    rows += [(100 + i, "същият текст") for i in range(2000)]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    got = E.encode_documents(df).collect()
    assert len(got) == len({r.doc_id for r in got}) == 2010
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in rows if i is not None}
    assert all(r.ids == want[r.doc_id] for r in got)
    assert E.encode_documents(df.limit(0)).count() == 0
