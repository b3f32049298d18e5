"""Documents and labels with everything that may be missing, empty, long, repeated or named like an inner column."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
EXTRA = "tag long, x int, y int, score double, gone long, cuts string, cut_doc long, kept string, draw double, topic string, tokens int, probability double, id long, key string, part int, kind int, band long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
_FILL = (1, 2, 3, 0.5, 4, "c", 5, "k", 0.1, "t", 6, 0.2, 7, "key", 8, 9, 10)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "a", "en", "or"]) for _ in range(n))


def rows() -> list[tuple]:
    long = prose(1, 30_000)
    near = prose(2, 300).split(" ")
    near[150] = "other"
    shared = prose(3, 70)
    found = [
        (1, prose(2, 300), "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, prose(2, 300), "de", None),
        (3, prose(2, 300), "de", None),
        (4, None, None, None),
        (5, "", "fr", "b"),
        (6, " \t\n ", "fr", "b"),
        (7, "one", "fr", "b"),
        (8, long, "es", "c"),
        (9, "start " + shared + " end of nine", "en", "a"),
        (10, "other beginning here " + shared + " ten", None, "c"),
        (10, "same id, another text " + shared, None, "c"),
        (None, prose(2, 300), "en", "a"),
        (None, None, None, None),
        (-5, "  négatif   double  spaces\r\nand <|endoftext|> marks ", "fr", "a"),
        (1 << 60, "İstanbul, été. 漢字 ☃ it's 'quoted'", "tr", "ü"),
    ]
    return [(d, t, la, s, None if t is None else len(t), *_FILL) for d, t, la, s in found]


def documents(spark, n: int | None = None):
    return spark.createDataFrame(rows()[:n], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, data=((1, 1, 0), (2, 1, 0), (3, 0, 1), (5, 0, 0), (5, 1, 1), (7, None, None), (None, 1, 1), (8, 1, 0), (9, 0, 1))):
    return spark.createDataFrame(list(data), "doc_id long, quality int, toxic int")


def sorted_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
