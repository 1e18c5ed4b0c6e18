import pytest
from pyspark.sql import types as T

#: Names that the operators use inside; as columns of an input they must not get in the way.
CLASHING = ["uid", "fp", "part", "ids", "dh", "n", "others", "at", "key", "kept", "th", "x", "k", "_keep", "_leak", "_id"]


def documents(spark, rows):
    """Documents with the columns of the table and further ones with awkward names."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), *[T.StringType()] * len(CLASHING)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    full = [(i, text, lang, source, None if text is None else len(text), *["z"] * len(CLASHING)) for i, text, lang, source in rows]
    return spark.createDataFrame(full, schema).repartition(3)


WORDS = "the of and to in that is was for on with as by at from it an be this which or are not had have but one all were when".split()


def prose(seed, n):
    """Words in an order that depends on the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 31 if (x >> 8 & 31) < len(WORDS) else x % len(WORDS)] + str(x >> 16 & 7))
    return " ".join(out)


AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n ", None, "a"),
    (4, "One.", "en", "a"),
    (5, prose(1, 120), "en", "b"),
    (6, prose(1, 120), "en", "b"),
    (6, prose(1, 120), "en", "b"),
    (7, prose(2, 90) + "\n" + prose(3, 60), "de", "c"),
    (7, prose(4, 30), "fr", "c"),
    (None, prose(3, 60), None, None),
    (None, None, None, None),
    (8, prose(2, 90), "xx", "c"),
    (9, "a b " * 300, "en", "d"),
    (10, prose(9, 30_000), "en", "e"),
    (11, "Ünïcode ÀÉ     x\x1cy <|endoftext|> \x00 end", "es", "e"),
    (12, prose(1, 60) + " changed " + prose(1, 120).split(" ", 61)[-1], "en", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
