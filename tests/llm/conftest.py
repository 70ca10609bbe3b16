import random

import pytest

from treeloom.llm.queries import ready

DOCS = "doc_id long, text string, lang string, source string, lines int, dropped string, node string, root string"


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented words."""
    dice = random.Random(4)
    words = ["".join(dice.choice("abcdefghilmnoprstu") for _ in range(dice.randint(3, 9))) for _ in range(900)]
    return lambda count, seed: " ".join(random.Random(seed).choices(words, k=count))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text) rows, with columns whose names operators use themselves."""
    ready(spark)
    return lambda rows: spark.createDataFrame([(k, t, None, "s", 7, "x", "y", "z") for k, t in rows], DOCS)


@pytest.fixture(scope="session")
def corpus(prose):
    """Copies, near copies, shared lines, nulls, empty, wordless, short and long texts, a repeated row and a repeated id."""
    base, line = prose(120, 1).split(), prose(40, 2)
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (5, 30, 60, 61, 119)]
    rows = [
        (1, " ".join(base)), (2, " ".join(base).upper()), (3, near[0]), (4, near[1]), (5, near[2]), (6, near[3]), (7, near[4]),
        (8, None), (9, ""), (10, " \n\t .,;"), (11, "one two"), (12, "one  TWO"), (13, prose(30_000, 3)),
        (14, f"{prose(50, 5)}\n{line}\n\nend of it"), (15, f"{line}\n{prose(50, 6)}\nend of it"), (15, f"{line}\n{prose(50, 6)}\nend of it"),
        (16, prose(80, 7)), (16, prose(80, 8)), (None, prose(60, 9)), (None, None), (17, "łódź ẞ Σ 漢字 " * 20), (18, "word " * 3000),
        (19, f"{line[:-1]}x\nend of it\nEND  of it!"),
    ]
    return rows
