"""Small tables with the cases that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _form string, size long, target string"


def docs(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang, source), with more columns whose names operators could use themselves."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "a")), len(r[1] or ""), "x", "y", 1, "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(n, seed=0, most=5000):
    """n invented words."""
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(most)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, words(4000, 5)), (6, "nul\x00byte é ß ▁ 日本 \n\n end")]
