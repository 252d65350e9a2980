"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(line: Column) -> Column:
    """Tokens of a line between runs of non-word characters.

    Trailing empty tokens are dropped and a leading one is kept: an empty line is
    one empty token, a line of separators alone has none.
    """
    words = F.regexp_extract_all(line, F.lit(r"\w+"), F.lit(0))
    return F.when(line == "", F.array(F.lit(""))).when(line.rlike(r"^\W+\w"), F.concat(F.array(F.lit("")), words)).otherwise(words)


def naive_fields(line: Column, *types: str) -> list[Column]:
    """Fields of a line cut at every comma, quotes or not, cast by position; a bad value raises."""
    parts = F.split(line, ",")
    return [F.element_at(parts, k + 1).cast(t) for k, t in enumerate(types)]


def last_field(line: Column, sep: str = ",") -> Column:
    return F.element_at(F.split(line, sep), -1)
