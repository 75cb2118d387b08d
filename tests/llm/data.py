"""Small tables with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 220)
    out = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = prose(rng, 80) + "\n\n" + base[:400] + "  " + prose(rng, 30)
        elif kind == 3:
            t = f"{prose(rng, 60)} password = 'hunter2abc{i % 4}' AKIA{'ABCDEFGH12345678'} {'0123456789abcdef' * 2}\n" * 2
        elif kind == 4:
            t = prose(rng, rng.randint(0, 5))
        else:
            t = "naïve 日本語 ▁ <s> \u2003\t" + prose(rng, 100)
        out.append((i, t, "en", ["a", "b/x", None][i % 3], len(t)))
    out += [(100, None, None, "a", None), (101, "", "en", None, 0), (102, prose(rng, 6000), "en", "c", 1), (102, out[0][1], "en", "c", 1)][:3]
    out += [out[0], out[1]]  # repeated rows
    return out


def docs(spark, extra: bool = False):
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in ("row", "key", "digest", "h", "size", "kept", "n_words", "ids", "id", "label", "found", "a", "b"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
