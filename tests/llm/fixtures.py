"""Tables of odd rows, and the small test data."""

import random

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, words int, removed string, start int, id string, root long, ranges string, item string, n_lines int"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the other columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] else None, "x", 1, "y", 2, "z", 3, "r", "i", 9) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(words, seed=0, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}n" for _ in range(words))


def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties and rows that occur twice."""
    return [
        (1, prose(60, 1), "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "fr"),
        (5, prose(60, 1), None),
        (6, "x", "en"),
        (7, prose(30000, 7), "en"),
        (7, prose(30000, 7), "en"),
        (None, prose(60, 1), "en"),
        (8, "é" * 300 + "\n" + "\0\x85 ok", "fr"),
    ]
