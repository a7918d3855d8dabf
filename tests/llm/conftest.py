import random

import pytest

WORDS = "the of and to in is was for that with as his on be at by he it not are from or have an they which one you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def prose(rng):
    """Makes texts of so many words with no long repeats in common."""

    def make(n: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def docs(spark):
    """A table of documents with a clashing extra column; rows are (doc_id, text)."""

    def make(rows):
        rows = [(i, t, "key", n) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, key string, fp int")

    return make


#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, a very long text, odd characters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "one"),
    (5, "Ünïcode ﬁ ① 漢字 \U0001f600 ▁ \x00 tail"),
    (5, "Ünïcode ﬁ ① 漢字 \U0001f600 ▁ \x00 tail"),
    (None, "no id"),
    (None, None),
    (6, "word " * 30_000),
    (7, "a\n\n\nb\r\n"),
]


@pytest.fixture
def odd():
    return list(ODD)
