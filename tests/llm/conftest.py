import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
PASSAGE = "this passage of more than fifty bytes is repeated in several of the documents"
BASE = " ".join(f"w{i}" for i in range(200))

TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "One two"),
    (6, "the same text  here"),
    (7, "the same text\there"),
    (8, LONG),
    (9, LONG + " end"),
    (10, BASE),
    (11, BASE.replace("w100 ", "")),
    (12, f"before {PASSAGE} after"),
    (13, f"{PASSAGE}{PASSAGE}"),
    (14, f"éß🙂 x▁y {PASSAGE} <|endoftext|>  z"),
    (15, "a" * 400),
    (16, "a" * 300),
    (17, "the same text here"),
]


@pytest.fixture(scope="session")
def texts():
    return dict(TEXTS)


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with extra columns whose names operators may use inside."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 0, "x", 1, "y", 0) for i, t in TEXTS]
    names = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int, tokens string, kept int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")
