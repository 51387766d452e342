"""String helpers shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() separators that Java's \s does not cover by default;
# (?U) adds the Unicode spaces, the explicit class adds the ASCII separators.
WS_SPLIT = r"(?U)[\s\x1c-\x1f]+"


def keyword_alternation(keywords, escape: bool = False) -> str:
    """One alternative for each blank-separated part of each keyword, empty
    parts included.  ``escape`` quotes the alternatives (themselves cut at
    ``|``) so they match literally."""
    parts = [part for k in keywords for part in k.split(" ")]
    if escape:
        parts = [re.escape(p) for part in parts for p in part.split("|")]
    return "|".join(parts)


def ci_search(col: Column, pattern: str) -> Column:
    """Case-insensitive regex search (Unicode case folding)."""
    return col.rlike("(?iu)" + pattern)


def tokens(col: Column) -> Column:
    """Whitespace tokens without empty strings (Python ``str.split()``)."""
    return F.filter(F.split(col, WS_SPLIT), lambda t: t != F.lit(""))
