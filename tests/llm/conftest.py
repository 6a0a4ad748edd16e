import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, or (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r if isinstance(r, tuple) else (i, r)) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", f"src{(i or 0) % 2}", -1 if t is None else len(t), 7, "x", None) for i, t in full],
            "doc_id long, text string, lang string, source string, n_chars long, n_lines int, Text string, id int",
        )

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
