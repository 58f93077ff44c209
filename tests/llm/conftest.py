import random

import pytest


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): originals, exact and near copies, shared passages, repeated lines, empty and null texts."""
    rng, rows = random.Random(5), []
    base = [words(rng, 130) for _ in range(12)]
    passage = words(rng, 64)
    for k, b in enumerate(base):
        rows.append((10 * k, " ".join(b)))
        rows.append((10 * k + 1, "\n".join(" ".join(b[i : i + 13]) for i in range(0, 130, 13))))
        near = list(b)
        near[rng.randrange(130)] = "Changed"
        rows.append((10 * k + 2, " ".join(near)))
        rows.append((10 * k + 3, " ".join(words(rng, 20) + passage + words(rng, 30 + k))))
        rows.append((10 * k + 4, " ".join(words(rng, 3 + k)) + "\n" + "\n".join(" ".join(b[i : i + 10]) for i in range(0, 40, 10)) + "\n\nshort"))
    rows += [(901, ""), (902, None), (903, " \t\n"), (904, "one two"), (905, "One TWO"), (906, "one two three four"), (907, " ".join(words(rng, 6000)))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < -5")
