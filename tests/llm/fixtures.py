"""Small documents with every awkward case: nulls, empty, very long, repeated, tied, and extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def rows() -> list[tuple]:
    passage = " ".join(words(1, 60))
    near = words(2, 120)
    edited = near[:50] + ["changed"] + near[51:]
    texts = [
        (1, "Plain words here. " + " ".join(words(3, 80))),
        (2, " ".join(words(4, 30)) + " " + passage + " " + " ".join(words(5, 20))),
        (3, passage + "\n" + " ".join(words(6, 40))),
        (4, " ".join(near)),
        (5, " ".join(edited)),
        (6, " ".join(near)),
        (7, ""),
        (8, None),
        (None, "no identifier\nbut two lines"),
        (9, " ".join(words(7, 30_000))),
        (10, "one two\nthree four\nfive six\nseven"),
        (10, "one two\nthree four\nfive six\nseven"),
        (11, "one two\nthree four\nfive six\nseven"),
        (12, "same same same same same same same same " * 12),
        (13, "same same same same same same same same " * 12),
        (14, "x"),
        (15, "... --- ..."),
        (16, "\n\n\n"),
        (17, "é ü 日本語 😀 \x00 ▁ tab\there"),
        (18, "A" * 5000),
    ]
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def clashing(df):
    """The same rows with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = ("mark", "hash", "score", "rank", "body", "sid", "family", "part", "bucket", "start", "n", "lead", "key", "__key", "label", "toxic", "quality", "item_id", "begin", "size", "root", "id", "_id", "__doc", "__mark", "__gone", "__removed", "gone", "sid", "first", "kept", "lines_removed_", "scored", "span")
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df
