import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table, with null cells and a column whose name clashes with the operators' own."""

    def build(rows):
        filled = [(i, t, "en", s, len(t or ""), f"x{n}") for n, (i, t, s) in enumerate(rows)]
        return spark.createDataFrame(filled, DOCUMENT + ", size string")

    return build


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
