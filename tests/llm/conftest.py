import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, component_id string, copies int, n_words string"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, ids that occur twice, odd characters."""
    texts = [None, "", " ", "\n\n", "one", "one two\n\nthree", "same words here", "same words here", "Same Words here", "a  b \t c\x0bd", "é É ß Σ ς 日本語 🙂 x", "tab\x1c\x85  　end ", "<|endoftext|> and <|startoftext|>",
             "it's we'll they'd 12345 !!! ... a\r\nb", "word " * 30000, "ab" * 40000, "line one\nline one\nline two\n" * 9, " lead and trail ", "x" * 7]
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4], 1, 7, 0.5, i % 2 == 0, "c", 3, "n") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (12, "another text of the same id", None, None, None, None, None, None, None, None, None), (None, "no id", "en", "s1", 1, 1, 0.1, True, "c", 1, "n"), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
