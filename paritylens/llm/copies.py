"""Problem 3: records that differ only in layout, letter case, punctuation or order of JSON fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paritylens.llm.consistent import consistent_form, text_key
from paritylens.llm.words import words
from paritylens.session import cut_lineage, spread


_BLANKS = " \t\n\r\x0b\x0c"


class _Fields(list):
    """The (name, value) pairs of a JSON object; a repeated name is kept."""


def _flat(value) -> str:
    """Words of a JSON value in an order that does not depend on the order of fields."""
    if isinstance(value, _Fields):
        return "{" + " ".join(sorted(f"{name.lower()} {_flat(v)}" for name, v in value)) + "}"
    if isinstance(value, list):
        return "[" + " ".join(map(_flat, value)) + "]"
    return str(value).lower()


def canonical_json(text: str) -> str | None:
    """The words of a JSON object or array, fields in one order; None for any other text.

    Numbers keep their spelling.  Letter case plays no part, so ``TRUE`` is a
    value like ``true``.
    """
    for attempt in (text, text.lower()):
        try:
            value = json.loads(attempt, object_pairs_hook=_Fields, parse_int=str, parse_float=str, parse_constant=str)
        except (ValueError, RecursionError):
            continue
        return _flat(value) if isinstance(value, list) else None
    return None


@F.pandas_udf(StringType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else canonical_json(x))


def canonical_text(form):
    """What records with the same content share: their words in order, fields of JSON objects sorted.

    A text without words is the same as others of its form; the empty text stays empty.
    """
    ends = F.concat(F.left(F.ltrim(form, F.lit(_BLANKS)), F.lit(1)), F.right(F.rtrim(form, F.lit(_BLANKS)), F.lit(1)))
    flat = _canonical_json(F.when(ends.isin("{}", "[]"), form))
    in_order = F.array_join(words(F.coalesce(flat, form)), " ")
    return F.when(in_order != "", in_order).otherwise(F.trim(form, F.lit(_BLANKS)))


def copy_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, first_id, n_copies) of every record with a content.

    Byte-identical contents are counted first; only distinct ones are brought
    to consistent form and canonical words, and the counts are summed over
    the full canonical text.  Null contents, and contents of nothing but
    blanks or characters without ink, are left out, as are rows without an id.  A repeated row counts as often as it occurs in ``n_copies``
    and has one row here.
    """
    records = spread(df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))).withColumn("raw", text_key(F.col("text")))
    survivors = records.groupBy("raw").agg(F.first("text").alias("text"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # The generator keeps the content from being made again for every use.
    content = F.explode(F.array(canonical_text(F.col("form")))).alias("content")
    canonical = consistent_form(survivors, "text").select("raw", "least", "n", content).where("content <> ''")
    canonical = cut_lineage(canonical.withColumn("key", text_key(F.col("content"))))
    # Grouped on the full text; what joins back is its key.
    classes = canonical.groupBy("content", "key").agg(F.min("least").alias("first_id"), F.sum("n").alias("n_copies")).select("key", "first_id", "n_copies")
    by_raw = canonical.select("raw", "key").join(classes, "key").select("raw", "first_id", "n_copies")
    return records.select("id", "raw").join(by_raw, "raw").select("id", "first_id", "n_copies").distinct()


def copy_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(first_id, id): every record but the first of each group with the same content."""
    return copy_classes(df, id_col, text).where("id <> first_id").select("first_id", "id")


def collapse(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, n_copies): one record for each content with its number of copies."""
    return copy_classes(df, id_col, text).where("id = first_id").select("id", "n_copies")
