"""Property tests: Spark text expressions agree with Python's str.strip / str.title."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ticketscope.functions.text import WHITESPACE_CHARS, strip, title_case

ALPHABET = ("abcxyzABCXYZ019'-_./&()" + "éÉüÜñÑøØçÇ" + WHITESPACE_CHARS)
texts = st.lists(st.text(alphabet=ALPHABET, max_size=24), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None)
@given(texts)
def test_strip_and_title_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", strip("s").alias("a"), title_case("s").alias("b")).collect()
    for r in got:
        assert r.a == r.s.strip(), repr(r.s)
        assert r.b == r.s.title(), repr(r.s)
