import pytest

CLASH = ("id", "size", "dup", "k", "n", "p", "key", "node", "head", "component", "chunk", "_lines", "_chunks", "score", "copies", "removed_lines", "target", "h", "vec", "cell", "_k1", "_k2", "_gone", "_ranges", "_hashes", "_ends", "_text", "_id", "_copies", "_nth", "row", "rows", "r", "words", "ids")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 9000}" for i in range(60_000)) + "\n" + "x" * 200_000
    rows = [(1, "a b c d e f\nsecond line here", "en", "s1", 3), (1, "a b c d e f\nsecond line here", "en", "s1", 3), (2, None, None, None, None), (3, "", "en", "s2", 0), (4, " \n\t\n", "en", "s2", 4), (None, "a b c d e f\nsecond line here", "en", "s1", 3), (None, None, None, "s1", None), (5, long, "de", "s3", len(long)), (6, "A B C d e f\nsecond line here", "fr", None, 3), (7, "é̂ 日本\u00a0x <|endoftext|> \u2003 y", "en", "s2", 9), (8, "word", "en", "s2", 4), (9, "\n\n\n", "en", "s2", 3), (1, "another text under one id", "en", "s1", 5)]
    return spark.createDataFrame([(*r, *(f"z{i}" for i in range(len(CLASH)))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
