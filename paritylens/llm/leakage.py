"""Problem 6: passages of evaluation items inside a corpus.

A document that shares n consecutive words with a passage shares one of its
own aligned blocks of half as many words, wherever the n words begin.  So 64-bit
hashes of all blocks of the passages are a set that every task holds, and of
each document only the aligned blocks are looked up in it, one for every half
window.  Around a hit the n-grams themselves are compared, so nothing is
found that is not there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paritylens.llm.words import WORD, words
from paritylens.session import cut_lineage, spread

#: Consecutive words that a document shares with a passage.
N = 12
#: Windows that are built at once, whatever the length of a passage.
PIECE = 2_000
#: Most hashes of blocks of passages that are broadcast (about 40 bytes each);
#: beyond, (document, hash) of the aligned blocks is shuffled, and no text.
BROADCAST_BLOCKS = 2_000_000

TAG = r"</?[A-Za-z][^<>\n]*>|&#?[A-Za-z0-9]{1,8};"


def plain_words(text: Column) -> Column:
    """Words of a text without markup tags and entities."""
    return words(F.when(text.rlike("[<&]"), F.regexp_replace(text, TAG, " ")).otherwise(text))


def windows(rows: DataFrame, keep: list[str], text: str, n: int = N) -> DataFrame:
    """(keep..., at, gram): every run of n words of each text; ``at`` counts words from 0.

    Null texts and texts with fewer words have none.
    """
    w = rows.where(F.col(text).isNotNull()).select(*keep, F.explode(F.array(plain_words(F.col(text)))).alias("__w")).where(F.size("__w") >= n)
    return _grams(w.withColumn("__first", F.lit(0)), keep, n)


def _grams(rows: DataFrame, keep: list[str], n: int) -> DataFrame:
    """(keep..., at, gram) of the words ``__w``, the first of which stands at ``__first``."""
    starts = F.sequence(F.lit(1), F.size("__w") - n + 1, F.lit(PIECE))
    pieces = rows.select(*keep, "__first", F.posexplode(F.transform(starts, lambda s: F.slice(F.col("__w"), s, PIECE + n - 1))).alias("__piece", "__part"))
    grams = F.transform(F.sequence(F.lit(1), F.size("__part") - n + 1), lambda i: F.array_join(F.slice(F.col("__part"), i, n), " "))
    return pieces.select(*keep, "__first", "__piece", F.posexplode(grams).alias("__at", "gram")).select(*keep, (F.col("__first") + F.col("__piece") * PIECE + F.col("__at")).alias("at"), "gram")


def _numbered(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _item_blocks(items: DataFrame, n: int, size: int) -> DataFrame:
    """(h): hashes of all runs of ``size`` words of the passages that have n words."""
    w = items.where(F.col("passage").isNotNull()).select(F.explode(F.array(_numbered(plain_words(F.col("passage"))))).alias("w")).where(F.size("w") >= n)
    return w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.xxhash64(F.slice("w", i, size)))).alias("h")).distinct()


def hits(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = N) -> DataFrame:
    """(doc_id, item_id, at): windows of documents that are n words of a passage.

    Passages with fewer than n words can't be found.  Rows with the same id are one document.
    """
    size = (n + 1) // 2
    asked = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage"))
    grams = windows(asked, ["item_id"], "passage", n).select("gram", "item_id").distinct()
    blocks = cut_lineage(_item_blocks(asked, n, size))
    corpus = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where(F.col("text").isNotNull())
    # The generator keeps the words from being cut anew for every use.
    w = corpus.select("doc_id", F.explode(F.array(plain_words(F.col("text")))).alias("w")).where(F.size("w") >= n)
    numbers = F.sequence(F.lit(0), F.floor((F.size("w") - size) / size).cast("int"))
    if blocks.count() <= BROADCAST_BLOCKS:
        w = w.select("doc_id", "w", F.explode(F.array(_numbered(F.col("w")))).alias("x"))
        # A block goes with the words of all windows that hold it.
        block = lambda i: F.struct(
            F.greatest(i * size - (n - size), F.lit(0)).alias("first"),
            F.xxhash64(F.slice("x", i * size + 1, size)).alias("h"),
            F.slice("w", F.greatest(i * size - (n - size), F.lit(0)) + 1, F.least(i * size, F.lit(n - size)) + n).alias("around"),
        )
        rows = w.select("doc_id", F.explode(F.transform(numbers, block)).alias("b")).select("doc_id", "b.*")
        near = rows.join(F.broadcast(blocks), "h", "left_semi").where(F.size("around") >= n)
        every = _grams(near.select("doc_id", F.col("first").alias("__first"), F.col("around").alias("__w")), ["doc_id"], n)
    else:
        rows = w.select("doc_id", F.explode(F.array(_numbered(F.col("w")))).alias("w")).select("doc_id", F.explode(F.array_distinct(F.transform(numbers, lambda i: F.xxhash64(F.slice("w", i * size + 1, size))))).alias("h"))
        near = rows.join(blocks, "h", "left_semi").select("doc_id").distinct()
        every = windows(corpus.join(near, "doc_id", "left_semi"), ["doc_id"], "text", n)
    return every.join(grams, "gram").select("doc_id", "item_id", "at").distinct()


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = N) -> DataFrame:
    """(doc_id, item_id, n_windows): documents with at least n consecutive words of the item's passage."""
    return hits(docs, doc_id, text, items, item_id, passage, n).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_docs) of the items that leaked."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


def _cut(text: str, starts: list[int], n: int) -> str:
    import regex

    # Words are those of plain_words: tags are passed over.
    spans = [m.span() for m in regex.finditer(f"(?:{TAG})(*SKIP)(*FAIL)|{WORD}", text)]
    out, at = [], 0
    gone = sorted({k for s in starts for k in range(s, s + n)})
    for i, k in enumerate(gone):
        if i == 0 or gone[i - 1] != k - 1:
            out.append(text[at : spans[k][0]])
        at = spans[k][1]
    return "".join(out) + text[at:]


def without_spans(docs: DataFrame, doc_id: str, text: str, found: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the leaked words cut out of ``text``; ``found`` are the hits."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _cut(t, list(s), n) for t, s in zip(texts, starts)], dtype=object)

    starts = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("at").alias("__starts"))
    both = docs.join(starts, F.col(doc_id) == F.col("__id"), "left")
    clean = F.when(F.col("__starts").isNull(), F.col(text)).otherwise(cut(F.col(text), F.col("__starts")))
    return both.withColumn(text, clean).drop("__id", "__starts")
