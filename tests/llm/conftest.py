import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = "\n".join(f"word{i} and again {i % 97} more, text." for i in range(30_000))
    line = "one two three four five six seven eight nine ten eleven"
    rows = [
        (0, None, "en", "a", 1), (1, "", "en", None, 0), (2, " \t\n", None, "a", 3), (3, long_text, "en", "b", 9), (None, "no id here", "en", "b", 1),
        (5, "the same row twice", "en", "a", 1), (5, "the same row twice", "en", "a", 1), (6, "the same row twice", "fr", "c", 1),
        (7, f"{line}\n{line}\n{line}\nand an end", "de", "c", None), (8, "a\tb c  d\n\n e 😀 <|endoftext|> don't", "en", "c", 4),
        (9, "A b, C d. E! " * 40, "en", "a", 1), (10, "x" * 5000, "en", "a", 1), (-3, "# $ % & | < > *", "en", "a", 1),
    ]
    rows = [(a, b.encode("utf-16", "surrogatepass").decode("utf-16") if b else b, *c) for a, b, *c in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
