"""Small tables with the awkward rows every operator has to bear."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, simhash string, size string, target string"
LONG_TEXT = "the quick brown fox " * 60_000


def docs(spark, rows, schema=DOCS):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([tuple([*r, *["x"] * 8][:8]) if len(r) < 8 else r for r in map(_full, rows)], schema)


def _full(row):
    doc_id, text, lang, source = [*row, None, None, None][:4]
    return (doc_id, text, lang, source, None if text is None else len(text), "clash", "clash", "clash")


AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n\x0b ", "de", "a"),
    (6, "one", "en", "a"),
    (7, "1234 !!! 5678", None, "b"),
    (None, "ein zwei drei vier fünf", "de", None),
    (None, None, None, None),
    (8, LONG_TEXT, "en", "c"),
    (9, "naïve 漢字 \U0001f600 q́uestion\x1cend", "fr", ""),
]
