"""Text helpers shared by parsers and line scanners (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends of text-mode reading: \r\n, \r and \n.
LINE_BREAK = r"\r\n|\r|\n"


def split_lines(content: Column) -> Column:
    """Whole text -> array of lines (no line end kept; a final line end adds one empty line)."""
    return F.split(content, LINE_BREAK)


def py_strip(s: Column) -> Column:
    """Strip leading/trailing Unicode whitespace (like ``str.strip()``)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def numbered_lines(content: Column) -> Column:
    """ARRAY<STRUCT<line INT, text STRING>> with 1-based line numbers.

    A trailing line end does not make an extra line, as in file iteration.
    """
    body = F.regexp_replace(content, r"(\r\n|\r|\n)$", "")
    return F.transform(split_lines(body), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
