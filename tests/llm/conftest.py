import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, fp long, shard int, term string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very long, tied and repeated rows, with extra columns named as the operators name theirs."""
    words = " ".join(f"word{i % 97}" for i in range(60))
    texts = [
        (0, "plain text of a few words"), (1, ""), (2, None), (3, "x" * 200_000), (4, "long tail " * 30_000), (5, words), (6, words), (7, words + "\n" + words),
        (8, "a\tb\nc\r\n  d \x1c e f"), (8, "a\tb\nc\r\n  d \x1c e f"), (9, "日本語 текст ñandú ½ 😀 idiot moron"), (10, " \n \t "), (None, "no id here at all"), (11, words),
    ]
    rows = [(i, t, None if i == 5 else "en", None if i in (2, 6) else f"s{(i or 0) % 3}", len(t) if t else 0, 1, 0.5, 7, 3, "t") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """A slice of the smallest driver table as (doc_id, text, source) rows."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return frame, [tuple(r) for r in frame.select("doc_id", "text", "source").orderBy("doc_id").collect()]
