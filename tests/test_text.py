import pytest
from pyspark.sql import functions as F

from ticketscope.functions.text import WHITESPACE_CHARS, strip, title_case

SAMPLES = [
    "  o'brien east-side 2nd st ", "MIDDLE EAST", "4-NOT SPECIFIED", "mcdonald's", "école",
    "　wide　", "\xa0nbsp\t", "\x1cfs\x1f", "a ", "", " ", "x  y", "ÉLAN vital",
    "hello-world_foo bar", "3rd AVE", "o'NEILL", "ǆemal",
]


def test_whitespace_set_is_python_isspace():
    assert sorted(WHITESPACE_CHARS) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES] + [(None,)], "s string")
    got = {r.s: r.t for r in df.select("s", strip("s").alias("t")).collect()}
    for s in SAMPLES:
        assert got[s] == s.strip(), repr(s)
    assert got[None] is None


@pytest.mark.parametrize("s", SAMPLES)
def test_title_case_matches_python(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(title_case("s").alias("t")).first().t == s.title()


def test_title_case_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(title_case(F.col("s")).alias("t")).first().t is None
