import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts with every awkward kind: null, empty, white space, special strings, marks, non-ASCII, long, repeated."""
    r = random.Random(4)
    odd = list("abDEé ñÑΣςİ\x1c\x85\xa0\t\n\r're12٣½<|>.,!-字😀ﬁ") + ["<|endoftext|>", "'LL", "the ", "of ", "license "]
    out = [None, "", " \n\t", "a" * 30_000, "word " * 9_000, "Same text twice.", "Same text twice.", "İΣ ΑΣ <|startoftext|>x"]
    return out + ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(120)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with a null id, a repeated row and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 3 else "de", "src0", len(t or ""), "x", -1, "y") for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s", 10, "x", -1, "y"), rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score string, n_tokens int, fp string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id = -5")
