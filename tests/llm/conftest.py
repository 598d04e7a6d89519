import pytest
from pyspark.sql import types as T

ODD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use inside.
    *[T.StructField(n, T.StringType()) for n in ("mark", "node", "words", "seeds", "spans", "rank", "slice", "id", "length", "row")],
])
PROSE = "The harbour was quiet when the first boats came in, and nobody on the quay had slept. Nets lay in heaps. A dog barked twice and lay down again."


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} sentence{i % 31}." for i in range(60_000))
    texts = [
        (1, PROSE), (1, PROSE), (2, PROSE + " Later it rained."), (3, None), (4, ""), (4, ""), (None, PROSE), (None, None), (5, long), (6, "   \n\n "),
        (7, "x"), (8, "İstanbul ǅ   \U0001F600 naïve ́"), (2, "Another text of the same id."), (9, "$$$ *** &&&"), (10, "\x00 nul \x1f <|endoftext|>"),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else "host.example.org", None, *["clash"] * 10) for i, t in texts]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture
def docs_of(spark):
    def make(texts):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    return make
