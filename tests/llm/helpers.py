from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, ids=None):
    """Documents of the given texts; ids count from 0 unless given."""
    ids = ids if ids is not None else range(len(texts))
    langs = langs if langs is not None else ["en"] * len(texts)
    rows = [(i, t, g, "s", len(t) if t is not None else None) for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
