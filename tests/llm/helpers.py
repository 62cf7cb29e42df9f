DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_table(spark, texts, ids=None, sources=None):
    """documents with given texts."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)
