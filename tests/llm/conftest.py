import random

import pytest

EXTRA = ["n_words", "score", "key", "size", "target", "component_id", "token", "id", "n", "at", "owner", "range", "copies", "spans", "y", "label"]


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source): null, empty, white, short, long, repeated, equal and near-equal texts; null ids and sources."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(30), prose(120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r", None), (4, "one", "b"), (5, "One", "b"), (6, "one two", "b"), (7, base, "c"), (8, base, None),
            (9, base.upper().replace(" ", "\n"), "c"), (10, " ".join(near), "c"), (11, prose(40) + " " + passage + " " + prose(40), "a"),
            (12, passage + "\x1cx " + passage, "a"), (13, "the " * 300, "b"), (14, prose(6000), "a"), (15, "été \U0001f600   nbsp end", "d"),
            (16, "x" * 5000, "d"), (20, base, "c"), (20, base, "c"), (21, prose(25), None), (-3, prose(60), "a"), (None, prose(50), "a"), (None, None, None),
            (40, prose(22), "e\U0001f600"), (41, prose(19), "e￿")]
    for i in range(60):
        edit = base.split()
        edit[rng.randrange(120)] = f"w{i}"
        rows.append((100 + i, " ".join(edit), "c"))
    for i in range(40):
        rows.append((200 + i, passage + " " + prose(rng.randint(0, 80)), "a"))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with more columns, whose names the operators use for their own."""
    docs = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in edge_rows], "doc_id long, text string, source string, lang string, n_chars long")
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit("other").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
