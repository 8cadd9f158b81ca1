import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use inside, as columns of the input.
CLASHING = ["th", "part", "h", "cls", "unit", "key", "size", "rid", "response", "packed", "words"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    near = prose(200).split()
    edited = [*near[:100], "zzzz", *near[101:]]
    texts = [
        (1, "first\n" + shared + "\nlast one here it is now"), (2, prose(40) + " " + shared), (3, None), (4, ""), (5, " \n "), (6, "!?"), (7, " ".join(near)), (8, " ".join(edited)),
        (9, " ".join(near)), (9, " ".join(near)), (10, prose(20_000)), (11, "aaaa" * 2000), (12, "one two"), (12, "one two three"), (None, prose(30)), (None, shared),
        (13, "a b c d e f g\na b c d e f x\na b c d e f"), (14, "a b c d e f g"), (15, "A b c d e f g h i j <|endoftext|> x"),
    ]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("extra") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
