import pytest

TABLES = {
    "a": "one two three four five six seven eight nine ten eleven",
    "long": " ".join(f"word{i % 977} and of" for i in range(60_000)),
}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated ids and rows, and columns whose names operators use themselves."""
    shared = "\n".join(["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and so on to the end of it."] * 2)
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from all of the hounds.", "en", 1, 10),
        (2, None, None, 2, None),
        (3, "", "en", 3, 0),
        (4, TABLES["long"], "en", 4, 5),
        (5, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", 5, 3),
        (5, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", 5, 3),
        (5, "another text of the same id", "en", 5, 3),
        (None, "a text without an id", None, 6, 2),
        (6, "The quick brown fox jumps over the lazy dog and runs far away from all of the hounds.", "en", 7, 1),
        (7, shared + "\nfirst end", "en", 8, 1),
        (8, "own start\n" + shared, "en", 9, 1),
        (9, "12 34 --- !!\n\t \x0b", None, 1, 1),
        (10, "é É  <|endoftext|>\n\n x\ty \x01 z", "fr", 1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key long, n_chars long").withColumnRenamed("key", "row").selectExpr("*", "'x' AS hash", "1 AS length", "2 AS text_key", "3 AS fp", "4 AS words")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
