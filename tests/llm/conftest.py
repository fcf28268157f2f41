import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))



def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def documents():
    """Small documents with copies, near copies, shared passages, blanks, nulls and a long text."""
    rng = random.Random(3)
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["été", "ñu", "中文"]
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(60, 200), vocabulary).replace(" wa", ".\nwa")))
    passage = prose(rng, 40, vocabulary)
    for i in range(60, 75):
        t = rows[i - 60][1].split(" ")
        t[len(t) // 2] = "changed"
        rows.append((i, " ".join(t)))  # near copies
    for i in range(75, 85):
        rows.append((i, rows[7][1]))  # a group of copies
    for i in range(85, 95):
        rows.append((i, prose(rng, 30, vocabulary) + "\n" + passage + "\n" + prose(rng, 30, vocabulary)))
    rows += [(95, None), (96, ""), (97, "  \t\n "), (98, "one"), (99, "two words"), (100, "spam\n" * 400),
             (101, prose(rng, 20000, vocabulary)), (102, "### $$$ %%% " * 60), (103, "ÄB CD! " * 60),
             (None, "text without an id, twice as long as it has to be " * 3), (104, "x" * 50000),
             (105, "tab\tand\x0bother\x0cblanks\r\nhere and é\x85中 joined"), (106, rows[3][1]), (106, rows[3][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, documents):
    """With further columns, of which some have the names that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, position long, _words string, label string"
    langs = ["en", "de", None]
    return spark.createDataFrame(
        [(d, t, langs[(d or 0) % 3], "src0", len(t) if t is not None else None, 1, "x", "y") for d, t in documents], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
