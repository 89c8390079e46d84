import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", kept boolean, n_tokens string, _row string, _id string, _text string, _key int, component_id int, _digest int"


def numbered(texts, lang="en", source="s/a"):
    return [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    def make(texts, **more):
        return spark.createDataFrame(numbered(texts, **more), DOCS)
    return make


@pytest.fixture
def awkward(spark):
    """Null and repeated ids and texts, empty and very long texts, columns with clashing names."""
    long = "lorem ipsum dolor " * 20_000
    rows = [
        (1, "Hello there, general reader of texts."), (1, "Hello there, general reader of texts."),
        (2, "hello there, general reader of texts."), (None, "hello there, general reader of texts."),
        (3, None), (4, ""), (5, "   \n\t "), (None, None), (6, long), (7, long + "end"), (8, "x" * 300_000),
        (9, "1" * 5000 + " a@b.co +1 (017) 555-7713 1.2.3.4"), (10, "é́ \U0001f600 中文 \x1c\x85 <|endoftext|>"),
        (11, "Hello there, general reader of texts."),
    ]
    filler = (True, "x", "r", "i", "t", 1, 2, 3)
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "s", None, *filler) for i, t in rows],
                                 DOCS + CLASHING)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS + CLASHING)
