"""Inputs that every operator must take: nulls, empty and long texts, repeats, foreign columns, no rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, token string, cell int, h string, key string, score string"


def docs(spark, rows):
    """rows: (doc_id, text[, lang]); further columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), 7, "x", None, 1, "h", "k", "s") for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "some text of a null id"), (None, None), (5, LONG), (6, "émigré ÉCOLE 中文 😀"), (7, "two\nlines here that repeat\n\n"), (8, "x\x1cy")]
