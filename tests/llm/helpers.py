"""Small tables and brute-force versions for the training-data operators."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs_table(spark, rows, partitions=3):
    """rows: (doc_id, text) or (doc_id, text, source) or with lang."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def empty_table(spark):
    return spark.createDataFrame([], DOCS)


def shared_texts(seed=5, n=40):
    """Texts with copies, near copies, shared passages and repeats inside a text."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(5, 160))
        if i % 5 == 1:
            text = f"{text} {passage} {prose(rng, 8)}"
        if i % 7 == 2 and rows:
            text = rows[-1][1]
        if i % 7 == 3 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        if i % 11 == 4:
            text = text + " " + text
        rows.append((i, text))
    return rows
