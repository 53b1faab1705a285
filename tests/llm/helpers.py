"""Small tables with the awkward cases, for every operator's tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaks string, n_lines int, __row string, keys string, score string"


def docs(spark, texts, first=1):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i + first if i is not None else None, t, None, "s", len(t or ""), "x", 1, "y", "z", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(words=30_000):
    return [None, "", "   \n\t ", "one", "a b c d e f g h i j k", "a b c d e f g h i j k", "é" * 50, "word%d " * 3, " ".join(f"w{i % 977}x{i % 31}" for i in range(words))]
