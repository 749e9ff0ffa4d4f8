import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows and ids, a column whose name
    clashes with the operators' own."""
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\x0b", "en", None), (None, "One two three four five six seven.", "en", "a"),
            (None, None, None, None), (4, "Häuser über Straßen " * 3000, "de", "b"), (5, "same words in this text here", "en", "b"),
            (5, "same words in this text here", "en", "b"), (6, "same words in this text here", "en", "c"),
            (6, "another text under the same id\nwith a shared line of text", "en", "c"),
            (7, "a line of its own\nwith a shared line of text", "en", "a"), (8, "WITH a shared LINE of text  \n\n", "fr", "zz")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1.0, "y", True) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string, fp double, "
                                 "size string, kept boolean")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
