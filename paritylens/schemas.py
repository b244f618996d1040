"""Schemas of the recorded log and the names used across the engine."""

from __future__ import annotations

from pyspark.sql import types as T

TRIO = ("A", "A_prime", "B")
TUPLE = ["recording_id", "input_id", "sample_idx"]

#: One line of a recording file; ``order`` and ``session`` are reserved words and become ord and session_no.
SAMPLE_LINE = T.StructType([
    T.StructField("input_id", T.StringType()),
    T.StructField("arm", T.StringType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("order", T.LongType()),
    T.StructField("output", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("session", T.IntegerType()),
])
REQUIRED = ["input_id", "arm", "sample_idx", "order", "output", "latency_ms"]

ORDERS = "order_id STRING, order_date STRING, client_id STRING, product_id STRING, qty INT, unit_price_eur DECIMAL(12,2), tax_rate_pct DECIMAL(12,2), total_eur DECIMAL(12,2), status STRING, payment_due DATE"
PRODUCTS = "product_id STRING, designation STRING, unit_price_eur DECIMAL(12,2)"
CLIENTS = "client_id STRING, company STRING, country STRING, language STRING"
TASKS = "inbound ARRAY<STRUCT<id:STRING, lang:STRING, theme:STRING, text:STRING>>, outbound ARRAY<STRUCT<id:STRING, kind:STRING, brief:STRING>>"


def roster_order(arms: list[str] | set[str]) -> list[str]:
    """The classic three first, the rest sorted."""
    return [a for a in TRIO if a in arms] + sorted(set(arms) - set(TRIO))
