"""Small tables with the awkward cases: nulls, empty and long texts, repeated
rows, ties, and extra columns whose names clash with the operators' own."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
            for _ in range(n)]


def prose(seed: int, n: int, words=None) -> str:
    r = random.Random(seed)
    w = words or vocabulary(1)
    return " ".join(r.choice(w) for _ in range(n))


def changed(text: str, n: int, seed: int = 3) -> str:
    """``text`` with ``n`` words replaced."""
    r = random.Random(seed)
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{i}x{seed}"
    return " ".join(w)


def documents() -> list[tuple]:
    base = prose(10, 120)
    long = prose(11, 6000)
    rows = [
        (1, base), (2, base), (3, base.upper() + "!"), (4, changed(base, 2)), (5, changed(base, 30)),
        (6, None), (7, ""), (8, "   \n\t"), (9, "hello there"), (10, "Hello, there."), (11, "hello"),
        (12, long), (13, changed(long, 100)), (14, prose(12, 50) + " " + base[:200]),
        (15, "日本語 テスト ①②③"), (16, "a  b\n\n c <|endoftext|> d \t e"), (17, "1 2 3 4 5"),
        (None, base), (18, prose(13, 80)), (18, prose(13, 80)), (19, "\u0000x y"),
    ]
    return [(i, t, "en" if k % 3 else None, f"s{k % 2}", len(t) if t else None)
            for k, (i, t) in enumerate(rows)]


def clash(df):
    """Columns that operators use inside."""
    from pyspark.sql import functions as F
    for c in ("_uid", "id", "key", "n", "rank", "shard", "length", "score", "size", "piece"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(documents() if rows is None else rows, schema)
