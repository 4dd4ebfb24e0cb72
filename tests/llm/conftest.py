import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, fp long, row int, group int, digest binary, more string"


@pytest.fixture
def frame(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def build(rows, langs=None):
        langs = langs or [None] * len(rows)
        full = [
            (i, t, lang, "src", None if t is None else len(t), "x", 7, 1, 2, b"d", "m")
            for (i, t), lang in zip(rows, langs, strict=True)
        ]
        return spark.createDataFrame(full, SCHEMA)

    return build


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (None, "no id"), (7, "same text here"), (7, "same text here"),
    (8, "Same Text Here"), (9, "same  text\nhere"), (10, "é 日本 👍 " * 5), (11, "word " * 4000), (12, "x" * 20000),
]


@pytest.fixture
def odd(frame):
    return frame(ODD)
