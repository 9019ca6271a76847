import random
import string

import pytest
from pyspark.sql import functions as F

LETTERS = "абвгдежзийклмнопрстуфхц"


def pseudo_words(rnd, n, letters=LETTERS):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n)]


@pytest.fixture
def rnd():
    return random.Random(7)


def clashing(df):
    """With further columns of names that the operators use inside."""
    for c in ("hash", "guard", "length", "part", "word", "form", "row", "seq", "chunk", "ids", "kind", "lang2", "n", "start", "host", "places", "key", string.ascii_lowercase):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df
