"""Text clean-up expressions: Unicode strip and word-wise title case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()), as a
# regex class usable by both Java regex and RE2:
# TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP, OGHAM SPACE MARK,
# EN QUAD .. HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"

# A word for title casing is a run of cased letters (upper, lower or title case);
# everything between words is carried through unchanged.
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{IsTitlecase}"
WORD_PATTERN = f"([{_CASED}]+|[^{_CASED}]+)"


# The same characters as a plain string, for the cheap first/last-character test.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column | str) -> Column:
    """Remove leading/trailing Unicode white space (Python ``str.strip``); null stays null.

    ``trim`` with an explicit character set is a small generated-code expression;
    ``STRIP_PATTERN`` is the equivalent regular expression (used by the SQL twins).
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.trim(c, F.lit(WHITESPACE_CHARS))


def title_case(col: Column | str) -> Column:
    """Title case where a word starts after any non-letter: ``o'brien 2nd`` → ``O'Brien 2Nd``.

    ``initcap`` alone only splits on spaces; splitting into cased/non-cased runs
    and capitalising each run reproduces Python's ``str.title``.
    """
    c = F.col(col) if isinstance(col, str) else col
    runs = F.regexp_extract_all(c, F.lit(WORD_PATTERN), 1)
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.array_join(F.transform(runs, lambda r: F.initcap(r)), ""))
