import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _bucket int, SIZE string"


def rows(seed=1, n=120):
    """Random documents with nulls, empty and long texts, copies, repeated ids, and extra columns with clashing names."""
    dice = random.Random(seed)
    words = ["".join(dice.choices("abcdefgh", k=dice.randint(1, 7))) for _ in range(300)] + ["É", "ß.", "#x", "LOUD", "a|b"]
    out = []
    for i in range(n):
        body = ["\n" if dice.random() < 0.06 else dice.choice(words) for _ in range(dice.choice([0, 1, 3, 20, 90, 400]))]
        text = dice.choice([" ", "  ", "\t"]).join(body)
        out.append((i, text, dice.choice(["en", "fr", None]), dice.choice(["a", "b", "b", "b", "é", None]), len(text), 7, "x"))
    out += [(n + i, out[5 + i][1], "en", "a", None, None, None) for i in range(6)]
    out += [(n + 10, None, None, None, None, 1, "y"), (n + 11, None, "en", "a", None, 1, "y"), (n + 12, "", "fr", "c", 0, 1, "y"), (n + 13, " \n\t ", None, "c", 0, 1, "y")]
    out += [out[3], out[3], (None, "no id at all", "en", "a", 12, 0, ""), (n + 14, " ".join(words) * 40, "en", "b", 0, 0, "")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
