"""Queries of the branches of operators that the other queries don't take, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritylens.operators import faults, fdr, grading, judging, log, pairings, probes, tools
from paritylens.plans import detect as plan
from paritylens.plans.detect_queries import ALL, FOUR
from paritylens.plans.log_queries import K, LABELS, samples
from paritylens.plans.registry import literal, query, table
from paritylens.plans.table_queries import PROBES, _probes

BY = ["recording_id"]


@query(f"""WITH p AS (SELECT recording_id, input_id, CAST(i AS INTEGER) AS sample_idx FROM (SELECT DISTINCT recording_id, input_id FROM samples), range({K}) r(i)),
c AS (SELECT p.*, arm, pos FROM p, (VALUES ('A', 0), ('A_prime', 1), ('B', 2)) v(arm, pos))
SELECT recording_id, input_id, sample_idx, arm, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx, input_id, ((pos - sample_idx) % 3 + 3) % 3) - 1 AS ord FROM c""")
def d6_sample_major_schedule(spark, d):
    return log.schedule(samples(spark, d), K, grouped=False).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {FOUR}, k AS (SELECT recording_id, CAST(round_even(target * 1e9, 0) AS BIGINT) AS t, greatest(CAST(round_even(near * 1e9, 0) AS BIGINT), CAST(round_even(far * 1e9, 0) AS BIGINT)) AS m FROM fd),
w AS (SELECT recording_id, greatest(t, m) AS wk, t > m AS win FROM k), c AS (SELECT recording_id, wk, count(*) FILTER (WHERE win) AS w, count(*) FILTER (WHERE NOT win) AS l FROM w GROUP BY ALL),
r AS (SELECT *, sum(w) OVER z AS nw, sum(l) OVER z AS nl FROM c WINDOW z AS (PARTITION BY recording_id ORDER BY wk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT * FROM r WHERE nw > 0 AND (1 + nl) / (2 * greatest(nw, 1)) <= 0.5e0 QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY nw DESC, wk DESC) = 1)
SELECT g.recording_id, wk AS threshold_key, CAST(coalesce(nw, 0) AS BIGINT) AS n_discoveries, round((1 + nl) / (2 * greatest(nw, 1)), 9) AS fdr_hat FROM (SELECT DISTINCT recording_id FROM k) g LEFT JOIN b USING (recording_id)""")
def e10_two_decoys_compete(spark, d):
    """Targets against the better of two decoys, at q = 0.5 as recordings with four arms are few inputs."""
    four = plan.with_modes(samples(spark, d), ("A", "A_prime", "B", "B_prime"))
    s = plan.scores(pairings.relabel(four, pairings.DESIGN_R), ["recording_id", "pairing"]).where("channel = 'mode_share'")
    both = pairings.near_and_far(s.where("pairing = 'primary'"), s.where("pairing = 'reverse'"), ["recording_id", "channel", "input_id"])
    return fdr.competition(both, BY, 0.5, fold=[])[0].withColumn("fdr_hat", F.round("fdr_hat", 9))


@query(ALL.rstrip() + f""", {LABELS}, f AS (SELECT DISTINCT recording_id, input_id FROM flags WHERE flagged), n AS (SELECT g.recording_id, count(f.input_id) AS n_flagged, count(t.input_id) AS tp FROM (SELECT DISTINCT recording_id FROM flags) g LEFT JOIN f USING (recording_id)
  LEFT JOIN (SELECT recording_id, input_id FROM fired WHERE fired) t ON t.recording_id = f.recording_id AND t.input_id = f.input_id GROUP BY 1)
SELECT recording_id, n_flagged, tp, round(CASE WHEN n_flagged > 0 THEN (n_flagged - tp) / n_flagged ELSE 0 END, 9) AS realised_fdr FROM n""")
def a28_realised_fdr(spark, d):
    """The library's form: a recording without a flag has a share of 0."""
    flagged = plan.judged(plan.scores(plan.with_modes(samples(spark, d)), BY), BY, 0.10)[0]
    g = grading.grade(flagged.where("flagged"), log.touched(table(spark, d, "activation")), BY)
    every = flagged.select("recording_id").distinct().join(g.select("recording_id", "n_flagged", "tp"), "recording_id", "left").fillna(0, ["n_flagged", "tp"])
    return every.withColumn("realised_fdr", F.round(grading.realised_fdr(F.col("n_flagged"), F.col("tp")), 9))


@query("SELECT msg_id, CAST('0x' || substr(sha256('7|F8:refusal@1/B3|' || client_id), 1, 8) AS BIGINT) / 4294967295e0 < 0.3e0 AS reached FROM messages WHERE client_id IS NOT NULL")
def f5_blast_by_principal(spark, d):
    """Regime B3: a fault reaches all messages of some clients."""
    cell = faults.cell_id("F8", "refusal", 1.0, "B3")
    return table(spark, d, "messages").where("client_id is not null").select("msg_id", faults.in_blast("B3", 0.3, 7, cell, F.col("msg_id").cast("string"), F.col("client_id")).alias("reached"))


@query("""WITH q AS (SELECT product_id AS input_id, substr(sha256('q/side|' || product_id), 16, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS side, CASE CAST(unit_price_eur AS INTEGER) % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'egal' END AS verdict FROM products)
SELECT CASE WHEN verdict = 'egal' THEN 'egal' WHEN (verdict = 'x') = side THEN 'm1' ELSE 'm2' END AS model, count(*) AS n FROM q GROUP BY 1""")
def a26_verdicts_by_model(spark, d):
    p = table(spark, d, "products")
    key = judging.queue(p.select(F.col("product_id").alias("input_id"), F.lit("m1").alias("left"), F.lit("m2").alias("right")), "q")
    said = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("egal")), (F.round("unit_price_eur", 0).cast("int") % 3 + 1).cast("int"))
    return judging.by_model(p.select(F.col("product_id").alias("input_id"), said.alias("verdict")), key.select("input_id", "X", "Y"))


@query("SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.o_orderkey IS NOT NULL THEN 'O' END AS status, CASE WHEN o.o_orderkey IS NULL THEN 'no such entity: ' || l.l_orderkey END AS error FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) o ON o.o_orderkey = l.l_orderkey")
def j6_stale_lookup(spark, d):
    """A stale read shows the first status of every entity."""
    o = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return tools.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey", "O").select("l_orderkey", "l_linenumber", "status", "error")


@query(rf"SELECT recording_id, line_no, regexp_replace(output, '^\s+|\s+$', '', 'g') <> '' AND error IS NULL AS activated, CASE WHEN regexp_replace(output, '^\s+|\s+$', '', 'g') <> '' AND error IS NULL THEN output || {literal(faults.ESCAPE_TEXT)} ELSE output END AS output FROM samples")
def g4_unicode_escape(spark, d):
    return faults.inject(samples(spark, d), "unicode_escape", 1.0).select("recording_id", "line_no", "activated", "output")


RATES = """t AS (SELECT shape AS channel, quantile_cont(score, 0.95) AS one, quantile_cont(score, 0.975) AS hi, quantile_cont(score, 0.025) AS lo FROM pr WHERE relation = 'PRESERVING' GROUP BY 1)"""


@query(f"WITH {PROBES}, {RATES} SELECT channel, category, count(*) AS n, round(avg(CASE WHEN channel = 'odd' THEN CASE WHEN score > hi OR score < lo THEN 1e0 ELSE 0e0 END WHEN score > one THEN 1e0 ELSE 0e0 END), 9) AS rate FROM pr JOIN t ON pr.shape = t.channel GROUP BY ALL")
def a25_detection_rates(spark, d):
    """Every category of every channel; the channel of odd ids is judged on both tails."""
    return probes.detection_rates(_probes(spark, d).withColumn("channel", F.col("shape")), ["odd"])
