import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"
#: Names that operators use inside; documents may have columns of these names too.
CLASHING = ["key", "doc", "row", "node", "n", "ids", "th", "label", "line", "place", "part", "clean", "_row", "_doc", "_id", "hash"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("tables not here")
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text, lang, source) rows to documents with clashing columns."""

    def make(rows):
        full = [(*r, None if r[1] is None else len(r[1]), *("x" for _ in CLASHING)) for r in rows]
        return spark.createDataFrame(full, KIND)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long and repeated texts, a null id."""
    plain = "the quick brown fox jumps over the lazy dog and then runs far away from all of them today"
    return [
        (0, None, "en", "a"), (1, "", None, None), (2, " \n\t\n ", "en", "b"), (3, plain, "en", "a"), (3, plain, "en", "a"),
        (4, f"{plain} again", "en", "b"), (5, "123 456 !!! \x00   \U0001f600", None, "c"), (None, f"{plain}\n{plain}", "en", "a"),
        (6, "x" * 5000, "en", "a"), (7, f"{plain}\n" * 400, "en", None), (8, "déjà vu <|endoftext|> ’ it's  two   blanks \r\n tail ", "fr", "a"),
    ]
