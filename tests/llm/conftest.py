import random

import pytest

CLASHES = "n_words long, score double, row long, rep long, packed string, spans string, kinds string, n_chars long, hi long"


def frame(spark, rows, kind="long"):
    """(doc_id, text) rows with extra columns of names that operators use inside."""
    extra = (1, 0.5, 2, 3, "p", "s", "k", 4, 5)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id {kind}, text string, {CLASHES}")


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows and ids, letters of many kinds, control characters."""
    r = random.Random(11)
    vocabulary = ["the", "Of", "alpha", "beta", "straße", "niño", "日本", "x1", "MIT", "license", "under", "released", "#", "|"]
    long = " ".join(r.choice(vocabulary) for _ in range(6000))
    lines = "\n".join(["same line here"] * 5 + ["", "  ", "other"])
    rows = [(1, "the alpha beta the alpha beta gamma delta"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (5, long), (5, "another text of that id"), (None, "no id at all but words"), (6, lines), (7, "a\x01b\x02c token=\x01abcdefgh"), (8, "one"), (9, "two words"), (10, "the alpha beta the alpha beta gamma delta"), (11, "\x0bv\x0c t  u n \x1c fs")]
    return rows + [(20 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(15)]
