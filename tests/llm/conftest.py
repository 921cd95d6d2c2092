"""Documents with every awkward case: nulls, empty and long texts, ties, repeats and clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, shard string, score string, size string, row string, epochs string, cut string, verdict string, spans string, component string, own_id string, suspect string"


def make_documents(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioustrnlé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    rows = [(i, ".\n".join(text(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(n)]
    base = text(80)
    words = base.split()
    for k in range(8):  # near copies with one to eight words changed
        w = list(words)
        for j in range(k):
            w[j * 9] = f"changed{k}{j}"
        rows.append((100 + k, " ".join(w), "en", "a"))
    shared = text(60)
    rows += [
        (200, base, "en", "a"), (201, base.upper(), "en", "b"), (202, "", "en", "a"), (203, None, None, None), (204, "   \n\t", "fr", "b"), (205, "one", "en", "a"), (206, "one", "en", "c"),
        (207, "two words here four", "en", "a"), (None, "null id text " + text(20), "en", "a"), (None, None, "en", "a"), (208, text(30000), "en", "a"), (209, shared + "\n" + text(30), "en", "a"),
        (210, text(30) + "\n" + shared, "fr", "b"), (0, rows[0][1], rows[0][2], rows[0][3]), (211, "Apache License, Version 2.0. Released under the MIT-License; cc by 4.0", "en", "a"),
        (212, "mail x.y+1@mail.example.com, ip 10.0.0.255 and 1.2.3.999, card 4111 1111 1111 1111 1, 4111-1111-1111-1111, tel +1 (555) 123-4567.", "en", "a"),
    ]
    return [(i, t, lang, source, len(t or ""), "x", None, "7", "y", "z", *"abcdefgh") for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
