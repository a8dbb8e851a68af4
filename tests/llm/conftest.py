import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, token_ids string, _text string, size string"


def rows_of(texts, first=0):
    """Documents with extra columns whose names operators use themselves."""
    return [(first + i, t, ["en", "de"][i % 2], f"src{i % 3}", len(t or ""), "own", "own", "own", "own", "own") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def build(rows):
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def messy(make):
    """Nulls in every column, empty and long texts, ties, repeated rows, supplementary characters."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = rows_of(["", None, "Hello there, world.", "hello THERE, world.", "ΑΒΓ 😀 déjà vu.\nline two\r\n\nline two", long, "a" * 200_000, "   \n\t ", "12345 67890 !!", long + " tail"])
    rows += [rows[2], rows[2], rows[5]]
    rows += [(None, "no id here at all", None, None, None, None, None, None, None, None), (None,) * 10, (2, "same id, other text", "en", None, 1, "", "", "", "", "")]
    return make(rows)
