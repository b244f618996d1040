"""Queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paritylens.functions import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Parts of SQL that many queries share.
LAST = """last AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY recording_id, input_id, sample_idx, arm ORDER BY line_no DESC) = 1),
tup AS (SELECT recording_id, input_id, sample_idx, count(DISTINCT arm) FILTER (WHERE arm IN ('A', 'A_prime', 'B')) = 3 AS complete,
  count(*) FILTER (WHERE error IS NOT NULL AND error <> '') >= 3 AS failed FROM last GROUP BY ALL),
kept AS (SELECT l.* FROM last l JOIN tup t USING (recording_id, input_id, sample_idx) WHERE complete AND NOT failed),
usable AS (SELECT * FROM kept WHERE error IS NULL)"""


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def literal(value: str) -> str:
    """A value of the engine as SQL writes it."""
    return "'" + value.replace("'", "''") + "'"


def text_sql(c: str) -> str:
    """The values are those of the text functions."""
    single = {k: v for k, v in X.PUNCTUATION.items() if len(v) == 1}
    x = f"translate({c}, {literal(''.join(single))}, {literal(''.join(single.values()))})"
    for k, v in X.PUNCTUATION.items():
        if len(v) > 1:
            x = f"replace({x}, {literal(k)}, {literal(v)})"
    for pattern, by in ((X.HEADING, ""), (X.MARKER, ""), ("[*_`]", ""), (r"[ \t]+", " "), (r"(?m)^[ \t\r]+|[ \t\r]+$", ""), (r"\n{2,}", "\n"), (r"^\s+|\s+$", "")):
        x = f"regexp_replace({x}, {literal(pattern)}, {literal(by)}, 'g')"
    return x


def mode_sql(c: str) -> str:
    s = strip_sql(c)
    return f"CASE WHEN regexp_matches({s}, '^[{{\\[]') AND json_valid({s}) THEN CAST(json({s}) AS VARCHAR) ELSE {text_sql(c)} END"


def words_sql(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"


def shape_sql(c: str) -> str:
    s = strip_sql(c)
    return rf"CASE WHEN {s} = '' THEN 'short' WHEN json_valid({s}) THEN 'json' WHEN len(regexp_extract_all({s}, {literal(X.MARKER)})) >= 2 THEN 'list' WHEN {words_sql(s)} <= 45 THEN 'short' ELSE 'prose' END"


MODED = LAST + f""",
moded AS (SELECT recording_id, input_id, arm, sample_idx, ord, line_no, output, {mode_sql('output')} AS mode, {shape_sql('output')} AS shape FROM usable)"""

DISTANCES = """,
mc AS (SELECT recording_id, input_id, mode, count(*) FILTER (WHERE arm = 'A') AS ca, count(*) FILTER (WHERE arm = 'A_prime') AS cp, count(*) FILTER (WHERE arm = 'B') AS cb FROM moded GROUP BY ALL),
mx AS (SELECT *, sum(ca) OVER w AS na, sum(cp) OVER w AS np, sum(cb) OVER w AS nb FROM mc WINDOW w AS (PARTITION BY recording_id, input_id)),
ms AS (SELECT recording_id, input_id, na, np, nb, count(*) AS n_modes, sum(abs(ca * nb - cb * na)) AS dt, sum(abs(ca * np - cp * na)) AS dd, sum(ca * ca) AS qa, sum(cp * cp) AS qp, sum(cb * cb) AS qb,
  sum(CASE WHEN ca = 0 THEN cb ELSE 0 END) AS vt, sum(CASE WHEN ca = 0 THEN cp ELSE 0 END) AS vd FROM mx WHERE na > 0 AND np > 0 AND nb > 0 GROUP BY ALL),
sp AS (SELECT *, CAST(na * na - qa AS DOUBLE) / CAST(na * na AS DOUBLE) AS a, CAST(np * np - qp AS DOUBLE) / CAST(np * np AS DOUBLE) AS p, CAST(nb * nb - qb AS DOUBLE) / CAST(nb * nb AS DOUBLE) AS b FROM ms),
dist AS (SELECT recording_id, input_id, na, np, nb, n_modes, CAST(dt AS DOUBLE) / CAST(2 * na * nb AS DOUBLE) AS mode_share_t, CAST(dd AS DOUBLE) / CAST(2 * na * np AS DOUBLE) AS mode_share_d,
  (greatest(a, b) - least(a, b)) / (greatest(a, b) + 1e-9) AS dispersion_t, (greatest(a, p) - least(a, p)) / (greatest(a, p) + 1e-9) AS dispersion_d,
  CAST(vt AS DOUBLE) / CAST(nb AS DOUBLE) AS novel_mode_t, CAST(vd AS DOUBLE) / CAST(np AS DOUBLE) AS novel_mode_d, a, p, b FROM sp),
shp AS (SELECT recording_id, input_id, shape, count(*) AS n, min(ROW(ord, line_no)) AS first FROM moded WHERE arm = 'A' GROUP BY ALL),
strata AS (SELECT recording_id, input_id, shape AS stratum FROM shp QUALIFY row_number() OVER (PARTITION BY recording_id, input_id ORDER BY n DESC, first) = 1),
sc AS (SELECT recording_id, input_id, stratum, channel, target, decoy FROM dist JOIN strata USING (recording_id, input_id),
  LATERAL (VALUES ('mode_share', mode_share_t, mode_share_d), ('dispersion', dispersion_t, dispersion_d), ('novel_mode', novel_mode_t, novel_mode_d)) v(channel, target, decoy))"""

SELECT = """,
eff AS (SELECT *, CAST(round_even(target * 1e9, 0) AS BIGINT) AS tk, CAST(round_even(decoy * 1e9, 0) AS BIGINT) AS dk,
  CASE WHEN count(*) OVER (PARTITION BY recording_id, channel, stratum) < 30 THEN '__pooled__' ELSE stratum END AS eff_stratum FROM sc),
ck AS (SELECT recording_id, channel, eff_stratum, k, sum(t) AS t, sum(d) AS d FROM
  (SELECT recording_id, channel, eff_stratum, tk AS k, 1 AS t, 0 AS d FROM eff UNION ALL SELECT recording_id, channel, eff_stratum, dk, 0, 1 FROM eff) GROUP BY ALL),
cu AS (SELECT *, sum(t) OVER w AS nt, sum(d) OVER w AS nd FROM ck WINDOW w AS (PARTITION BY recording_id, channel, eff_stratum ORDER BY k DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ce AS (SELECT *, CAST(1 + nd AS DOUBLE) / CAST(greatest(nt, 1) AS DOUBLE) AS est FROM cu),
grp AS (SELECT DISTINCT recording_id, channel, eff_stratum FROM eff),
pick AS (SELECT recording_id, channel, eff_stratum, k, nt, est FROM ce WHERE t > 0 AND est <= 0.1e0 QUALIFY row_number() OVER (PARTITION BY recording_id, channel, eff_stratum ORDER BY nt DESC, k DESC) = 1),
sel AS (SELECT g.*, k AS threshold_key, CAST(coalesce(nt, 0) AS BIGINT) AS n_discoveries, est AS fdr_hat FROM grp g LEFT JOIN pick p USING (recording_id, channel, eff_stratum)),
best AS (SELECT recording_id, channel, eff_stratum, k AS cut_key, nt AS targets_above, nd AS decoys_above, est AS estimate, nd = 0 AND nt > 0 AS separated FROM ce WHERE t > 0
  QUALIFY row_number() OVER (PARTITION BY recording_id, channel, eff_stratum ORDER BY est, k DESC) = 1),
flags AS (SELECT e.*, threshold_key, coalesce(tk >= threshold_key, false) AS flagged FROM eff e JOIN sel s USING (recording_id, channel, eff_stratum))"""
