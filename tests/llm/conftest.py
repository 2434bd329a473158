import random

import pytest

WORDS = "the of and river stone light harbor winter copper lantern meadow silver window garden thunder castle forest engine letter ocean".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", "", ".", ","])) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and odd white space, a long text, ties."""
    shared = prose(99, 60)
    rows = [(i, prose(i, 40 + i)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, rows[4][1].replace("river", "lake", 1))]
    rows += [(23 + i, f"{prose(200 + i, 30)} {shared}\n{prose(300 + i, 15)}") for i in range(4)]
    rows += [(27, None), (28, ""), (29, " \t\n "), (30, "One word \x0b two\x0c three"), (31, "le " * 50), (32, prose(7, 9000)), (33, "Été CAFÉ naïve 漢字 🙂 <|endoftext|>!")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts under an extra column whose names clash with the operators' own, in several partitions, with one row repeated."""
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t) if t is not None else None, "x", -1.0) for i, t in [*texts, texts[5]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
