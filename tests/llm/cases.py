"""Rows that every operator must take: nulls, empty and long texts, repeated rows, further columns with clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, node long, toxicity string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def odd_docs(spark):
    long = words(1, 6000)
    texts = [None, "", " ", "x", "\n\n", long, long, words(2, 300), words(2, 300) + " tail", "é漢字😀 " * 200, "a" * 3000]
    rows = [(i, t, "en", "s", 0, "r", "s", 1, "t") for i, t in enumerate(texts)]
    rows += [rows[7], (None, words(2, 300), None, None, None, None, None, None, None), (7, words(3, 50), "en", "s", 0, "r", "s", 1, "t")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
