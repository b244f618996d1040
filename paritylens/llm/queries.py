"""Queries of the text problems and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylens.llm.consistent import lookalike_pairs, same_form_classes
from paritylens.llm.copies import collapse, copy_pairs
from paritylens.llm.leakage import hits, leaked_items, leaks, without_spans
from paritylens.llm.mixing import copies, mix_report, mixing_plan
from paritylens.llm.near import near_classes, near_pairs
from paritylens.llm.repetition import repeated_share, repetitive
from paritylens.llm.residue import residue
from paritylens.llm.truncation import endings, truncation_rates

#: Least similarity of p1, as its statement gives it.
SIMILAR = 0.7


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "messages").select("msg_id", "text")


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "ollama_chat").select(
        "chat_id", "captured_from", F.col("response.message.content").alias("content"), F.col("response.done").alias("done"), F.col("response.done_reason").alias("done_reason")
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, text) of both tables of p2."""
    a = _messages(spark, d).select(F.lit("messages").alias("tbl"), F.col("msg_id").alias("id"), "text")
    return a.unionByName(_replies(spark, d).select(F.lit("ollama_chat").alias("tbl"), F.col("chat_id").alias("id"), F.col("content").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(_messages(spark, d), "msg_id", "text", SIMILAR).select(F.col("id_a").alias("msg_a"), F.col("id_b").alias("msg_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per message: its class of equal words and how many other classes are near."""
    members, links = near_classes(_messages(spark, d), "msg_id", "text", SIMILAR)
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias("msg_id"), F.col("rep").alias("class_id"), "n_records", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(_texts(spark, d), ["tbl"], "id", "text")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record whose consistent form another record shares."""
    classes = same_form_classes(_texts(spark, d), ["tbl"], "id", "text")
    first = classes.groupBy("tbl", "form_key").agg(F.min("id").alias("class_id"))
    return classes.join(first, ["tbl", "form_key"]).select("tbl", "id", "class_id", "n_records", "n_texts")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_pairs(_replies(spark, d), "chat_id", "content").select(F.col("first_id").alias("first_chat_id"), F.col("id").alias("chat_id"))


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_replies(spark, d), "chat_id", "content").select(F.col("id").alias("chat_id"), "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive(_replies(spark, d), "chat_id", "content").select(F.col("id").alias("chat_id"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeated_share(_replies(spark, d), "chat_id", "content").select(F.col("id").alias("chat_id"), F.col("n_words").cast("long"), F.col("n_repeated").cast("long"), F.round("share", 9).alias("share"))


def _endings(spark: SparkSession, d: str) -> DataFrame:
    return endings(_replies(spark, d), "chat_id", "content", "captured_from", "done", "done_reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _endings(spark, d).where("cut").select(F.col("id").alias("chat_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(_endings(spark, d)).withColumnRenamed("source", "captured_from")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "passage").select("doc_id", "item_id")


def p6_leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(p6_found(spark, d))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return without_spans(docs.select("doc_id", "text"), "doc_id", "text", hits(docs, "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "passage"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return copies(docs, mixing_plan(docs, _table(spark, d, "mix_targets"), "source", "n_tokens"), "doc_id", "source", "n_tokens").select("doc_id", "copies")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(_table(spark, d, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"))


def p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue(_table(spark, d, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"), "why")


QUERIES = [p1_found, p1_classes, p2_found, p2_classes, p3_found, p3_copies, p4_found, p4_shares, p5_found, p5_rates, p6_found, p6_leaked, p6_cleaned, p7_mix, p7_copies, p8_found, p8_reasons]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


_SHARES = r"""
WITH t AS (SELECT chat_id, regexp_extract_all(lower(response.message.content), '[\p{L}\p{Nd}]+') AS w FROM ollama_chat WHERE response.message.content IS NOT NULL),
g AS (SELECT chat_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM t WHERE len(w) >= 5),
s AS (SELECT chat_id, k, row_number() OVER (PARTITION BY chat_id, array_to_string(list_slice(w, k, k + 4), ' ') ORDER BY k) > 1 AS again FROM g),
c AS (SELECT chat_id, least(5, coalesce(lead(k) OVER (PARTITION BY chat_id ORDER BY k) - k, 5)) AS cover FROM s WHERE again),
r AS (SELECT chat_id, sum(cover) AS n_repeated FROM c GROUP BY chat_id),
shares AS (SELECT t.chat_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated FROM t LEFT JOIN r USING (chat_id))
"""
_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>\n]*>|&#?[A-Za-z0-9]{1,8};', ' ', 'g')), '[\p{L}\p{Nd}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{Nd}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram))
"""
_MIX = """
WITH have AS (SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS available FROM documents WHERE n_tokens > 0 GROUP BY source),
p AS (SELECT m.source, target_share, CAST(max_repeats AS BIGINT) AS max_repeats, coalesce(n_docs, 0) AS n_docs, coalesce(available, 0) AS available,
  CASE WHEN available > 0 AND target_share > 0 THEN target_share END AS usable FROM mix_targets m LEFT JOIN have h ON m.source = h.source),
q AS (SELECT *, usable / sum(usable) OVER () AS share FROM p),
plan AS (SELECT *, least(share * min(CASE WHEN share IS NOT NULL THEN available * max_repeats / share END) OVER () / nullif(available, 0), max_repeats) AS expected,
  CAST('0x' || substr(md5('mix|' || source), 1, 8) AS BIGINT) / 4294967296e0 AS shift FROM q),
ranked AS (SELECT doc_id, d.source, n_tokens, expected, shift, row_number() OVER (PARTITION BY d.source ORDER BY md5('mix|' || CAST(doc_id AS VARCHAR)), doc_id) AS place
  FROM documents d JOIN plan p ON d.source = p.source WHERE n_tokens > 0 AND expected > 0),
used AS (SELECT doc_id, source, n_tokens, CAST(floor(place * expected + shift) - floor((place - 1) * expected + shift) AS BIGINT) AS copies FROM ranked)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _SHARES + "SELECT chat_id FROM shares WHERE n_words >= 40 AND n_repeated * 10 >= n_words * 3",
        "p4_shares": _SHARES + "SELECT chat_id, n_words, n_repeated, round(CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0e0 END, 9) AS share FROM shares",
        "p6_found": _LEAKS + "SELECT doc_id, item_id FROM found",
        "p6_leaked": _LEAKS + "SELECT item_id, count(*) AS n_docs FROM found GROUP BY item_id",
        "p7_copies": _MIX + "SELECT doc_id, copies FROM used WHERE copies > 0",
        "p7_mix": _MIX
        + """, s AS (SELECT source, count(*) AS docs_used, CAST(sum(copies) AS BIGINT) AS repeats, max(copies) AS most_repeats, CAST(sum(copies * n_tokens) AS BIGINT) AS tokens FROM used WHERE copies > 0 GROUP BY source)
SELECT p.source, target_share, max_repeats, n_docs, available, coalesce(docs_used, 0) AS docs_used, coalesce(repeats, 0) AS repeats, coalesce(most_repeats, 0) AS most_repeats, coalesce(tokens, 0) AS tokens,
  round(coalesce(tokens, 0) / sum(tokens) OVER (), 9) AS share FROM plan p LEFT JOIN s ON p.source = s.source""",
    }
