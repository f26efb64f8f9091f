import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, words string"

#: Nulls, empty texts, ties, repeated rows, white space, odd characters; and columns whose names operators use themselves.
ROWS = [
    (1, "The cat sat on the mat. The cat sat on the mat.\nThe cat sat on the mat.", "en", "a"),
    (2, "the CAT sat on the mat.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n\x0b ", "de", "b"),
    (6, "Der Hund und die Katze sind im Haus, das ist schön. İ ΑΣ ﬁ 42,7 <|endoftext|> don't", "de", None),
    (6, "Der Hund und die Katze sind im Haus, das ist schön. İ ΑΣ ﬁ 42,7 <|endoftext|> don't", "de", None),
    (7, "un deux trois", "fr", "c"),
    (7, "un deux quatre", "fr", "c"),
    (None, "no id at all here", "en", "a"),
    (None, None, None, None),
    (8, "x\x00y " * 30 + "émile " * 40, "fr", "c"),
    (9, "one two", "en", "é"),
    (10, " ".join(f"w{i * 7919 % 1000}" for i in range(9000)), "en", "a"),
]


def rows_of(rows):
    return [(*r, len(r[1]) if r[1] is not None else None, 1.0, 2, "w") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(ROWS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
