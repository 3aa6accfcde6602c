"""Word splitting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Fixed value: the characters a word ends at, those of the pattern \\s.
WHITESPACE = " \t\n\x0b\f\r"


def tokens(text: Column) -> Column:
    """Lower-cased words split on every single whitespace character.

    Empty words inside the text stay, trailing ones go, as in MLlib's
    ``Tokenizer``; null counts as the empty text.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    body = F.rtrim(lowered, F.lit(WHITESPACE))
    no_words = (lowered != "") & (body == "")
    return F.when(no_words, F.array().cast("array<string>")).otherwise(F.split(body, r"\s"))
