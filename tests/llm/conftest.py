import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) pairs, over several partitions, with an extra column that clashes with internal names."""

    def make(rows, partitions=3, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], KIND).repartition(partitions)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({"k": F.lit(1), "h": F.lit("x"), "fp": F.lit(0), "marks": F.lit(None).cast("string"), "size": F.lit(9), "score": F.lit("s")})
        return df

    return make


#: Nulls, empty, blank, one word, ties, repeated rows, another id with an equal text.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "two words"), (6, "same text here now"), (6, "same text here now"), (7, "same text here now"), (8, "é ß 日本語 🙂 \x85 x")]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Ids and texts with exact and near copies, shared passages, a long text and repeated lines."""
    rng = random.Random(5)
    out = [(1000 + i, words(rng, rng.randint(1, 200))) for i in range(60)]
    shared = words(rng, 60)
    out += [(100 + i, f"{words(rng, 30)} {shared} {words(rng, 20)}") for i in range(8)]
    long = words(rng, 4000)
    out += [(200, long), (201, long), (202, long.replace(long.split()[5], "changed", 1)), (203, long + " end")]
    out += [(300, (words(rng, 12) + "\n") * 30), (301, "a b c " * 200)]
    return out + EDGES
