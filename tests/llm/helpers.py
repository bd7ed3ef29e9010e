"""Small corpora for the tests of the corpus operators."""

import random
import re

LONG = "alpha beta gamma delta " * 20_000


def prose(rng, n, syllables=("on", "er", "th", "ing", "ra", "lo", "mi", "ve", "su", "ka")):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows, **extra):
    """doc_id and text, with columns whose names the operators use themselves."""
    names = {"id": "int", "row": "string", "n": "int", "digest": "string", "rep": "int", "key": "int", "score": "string"}
    schema = "doc_id long, text string, " + ", ".join(f"{k} {v}" for k, v in names.items())
    return spark.createDataFrame([(i, t, 1, None, 2, None, 3, None, "x") for i, t in rows], schema)


def edge_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "One."), (4, "One."), (5, LONG), (6, LONG), (None, "Two words"), (7, "!!! 123 ...")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^ \t-\r]+", low)


def near_copies(seed=3, groups=6):
    """Texts with copies changed in more and more words, across the similarity of 0.8."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = prose(rng, rng.choice((12, 60, 200))).split(" ")
        for change in (0, 0.01, 0.03, 0.05, 0.06, 0.08, 0.12, 0.3):
            copy = [prose(rng, 1) if rng.random() < change else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows
