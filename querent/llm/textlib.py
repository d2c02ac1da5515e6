"""Expressions on texts that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the corpus contracts besides the space itself.
OTHER_SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")


def count_words(text: Column) -> Column:
    r"""The number of ``[^\x20\x09-\x0D]+`` words, 0 for null, without a regular expression.

    All white space becomes a space; each space then becomes the pair TAB LF (free by now), adjoining
    LF TAB pairs vanish, and so one TAB is left for every run of spaces between words.
    """
    plain = F.coalesce(text, F.lit(""))
    for space in OTHER_SPACES:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    plain = F.trim(plain)
    squeezed = F.replace(F.replace(plain, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"), F.lit(""))
    gaps = F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit("\t"), F.lit("")))
    return F.when(plain == "", F.lit(0)).otherwise(gaps + 1).cast("long")
