"""Small tables with awkward rows."""

import random

SCHEMA = "doc_id long, text string, lang string, part int, id long, score string, `n words` int"


def table(spark, rows):
    """Documents with extra columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, None, 1, 7, "x", None) for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(n, seed, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))
