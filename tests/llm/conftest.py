import pytest

LONG = " ".join(f"word{i % 997}x{i}" for i in range(40_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns whose names the operators use themselves."""
    a = "The river and the hill are in the valley of the old town by the sea"
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, None, "de", "s2"), (4, "", None, None), (5, LONG, "en", "s2"),
        (6, a + " now", "en", "s1"), (7, "x", None, "s3"), (7, "x", None, "s3"), (None, a, "en", None), (None, None, None, None),
        (8, " \t\n ", "fr", "s1"), (9, "ÄÖ é 𝒳 日本", "de", "s2"), (10, "le chat\nle chat\n\nun chien", "fr", "s3"), (11, "1234 5678 !!", "es", "s1"),
    ]
    full = [(*r, len(r[1] or ""), "clash", 1, 2, 3.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long,"
                                       " __row string, size int, shard int, score double")
