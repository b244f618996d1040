"""Words of a text: maximal runs of letters or digits, in lower case, in text order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """The words as an array; null for a null text, empty for one without words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
