import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["score", "__text", "__id", "__spans", "ids", "n_tokens", "key", "node", "cid", "sig", "term", "rank", "items", "kept", "host", "section", "query_id", "turns"]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def documents(spark, texts):
    """documents from texts, or from (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
