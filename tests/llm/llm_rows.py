"""Rows of documents with every awkward case."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target double, size long, kept boolean, kept_id long, row string, spans string"


def table(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), 1.0, 7, True, 5, "x", "y") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, "one two three four five six", "en", "a"),
    (2, "One TWO three four five six", "en", "a"),
    (2, "One TWO three four five six", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n\x0b\x0c\r ", "en", "b"),
    (6, "word", None, "b"),
    (7, "word", "fr", None),
    (None, "mail a@b.co and +49 30 1234567 or 10.0.0.1", "de", "c"),
    (None, None, None, None),
    (8, "Größe naïve 😀 'tis \u0000 end <|endoftext|>", "de", "c"),
    (9, "long " * 60_000 + "4111 1111 1111 1111", "en", "a"),
    (10, "12345 67890 !!", "en", "c"),
    (-5, "one two three four five six seven", "en", "d"),
]
