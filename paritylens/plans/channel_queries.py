"""Queries of the whole detector, of several pairings and of the tool layer's rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.operators import diagnosis, faults, fdr, generators, judging, log, modes, pairings, simulation, tools
from paritylens.plans import detect as plan
from paritylens.plans import studies
from paritylens.plans.log_queries import K, LABELS, samples
from paritylens.plans.registry import DISTANCES, LAST, MODED, SELECT, mode_sql, query, shape_sql, table

BY = ["recording_id"]

# -- all channels ---------------------------------------------------------------

_OWN = "sc AS (SELECT recording_id, input_id, stratum, channel, target, decoy FROM dist"
SIX = (
    MODED
    + DISTANCES.replace(_OWN, _OWN.replace("sc AS", "sc0 AS"))
    + r""",
inp AS (SELECT recording_id, input_id, stratum FROM dist JOIN strata USING (recording_id, input_id)),
tok AS (SELECT recording_id, input_id, arm, unnest(regexp_extract_all(lower({text}), '[\p{L}\p{N}_]+')) AS word FROM usable),
tc AS (SELECT recording_id, input_id, word, count(*) FILTER (WHERE arm = 'A') AS ca, count(*) FILTER (WHERE arm = 'B') AS cb FROM tok GROUP BY ALL),
dr AS (SELECT recording_id, input_id, 1e0 - coalesce(CAST(sum(least(ca, cb)) AS DOUBLE) / nullif(CAST(sum(greatest(ca, cb)) AS DOUBLE), 0), 1) AS drift_t FROM tc GROUP BY ALL),
e4 AS (SELECT recording_id, input_id, arm, length(regexp_replace(output, '[^A-Za-z]', '', 'g')) AS x1, length(regexp_replace(output, '[^0-9]', '', 'g')) AS x2, length(output) AS x3 FROM usable WHERE arm IN ('A', 'A_prime', 'B')),
en AS (SELECT *, sqrt(CAST(x1 * x1 + x2 * x2 + x3 * x3 AS DOUBLE)) AS norm FROM e4),
ed AS (SELECT recording_id, input_id, arm, unnest([1, 2, 3]) AS dim, CASE WHEN norm > 0 THEN unnest([x1, x2, x3]) / norm ELSE 0e0 END AS x FROM en),
em AS (SELECT recording_id, input_id, dim, avg(x) FILTER (WHERE arm = 'A') AS a, avg(x) FILTER (WHERE arm = 'A_prime') AS p, avg(x) FILTER (WHERE arm = 'B') AS b FROM ed GROUP BY ALL),
es AS (SELECT recording_id, input_id, sum(a * a) AS aa, sum(p * p) AS pp, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * p) AS ap FROM em GROUP BY ALL),
far AS (SELECT i.*, coalesce(drift_t, 0) > 0.25e0 AS blocked, CASE WHEN aa > 0 AND bb > 0 THEN 1 - ab / sqrt(aa * bb) ELSE 0 END AS t, CASE WHEN aa > 0 AND pp > 0 THEN 1 - ap / sqrt(aa * pp) ELSE 0 END AS d
  FROM inp i JOIN es USING (recording_id, input_id) LEFT JOIN dr USING (recording_id, input_id)),
gt AS (SELECT recording_id, count(*) AS n_inputs, count(*) FILTER (WHERE blocked) AS n_blocked, 2 * count(*) FILTER (WHERE blocked) > count(*) AS skip FROM far GROUP BY 1),
pl AS (SELECT recording_id, input_id, arm, output, row_number() OVER (PARTITION BY recording_id, input_id, arm ORDER BY sample_idx, ord, line_no) AS place FROM usable),
pp AS (SELECT a.recording_id, a.input_id, b.arm, a.output AS x, b.output AS y FROM pl a JOIN pl b ON a.recording_id = b.recording_id AND a.input_id = b.input_id AND a.place = b.place AND a.arm = 'A' AND b.arm IN ('B', 'A_prime')),
jd AS (SELECT recording_id, input_id, arm, CASE WHEN left(x, 8) <> left(y, 8) OR right(x, 8) <> right(y, 8) THEN 1e0 ELSE 0e0 END AS c,
  least(length(x), length(y)) / greatest(length(x), 1) - least(length(x), length(y)) / greatest(length(y), 1) AS g FROM pp),
jm AS (SELECT recording_id, input_id, avg(c) FILTER (WHERE arm = 'B') AS ct, avg(c) FILTER (WHERE arm = 'A_prime') AS cd, avg(g) FILTER (WHERE arm = 'B') AS gt, avg(g) FILTER (WHERE arm = 'A_prime') AS gd FROM jd GROUP BY ALL),
sc AS (SELECT * FROM sc0 UNION ALL SELECT recording_id, input_id, stratum, 'embedding', CASE WHEN blocked THEN 0 ELSE t END, CASE WHEN blocked THEN 0 ELSE d END FROM far JOIN gt USING (recording_id) WHERE NOT skip
  UNION ALL SELECT recording_id, input_id, stratum, 'nli_contradiction', ct, cd FROM inp JOIN jm USING (recording_id, input_id) UNION ALL SELECT recording_id, input_id, stratum, 'nli_directional', abs(jm.gt), abs(gd) FROM inp JOIN jm USING (recording_id, input_id))"""
)


def _six_sql() -> str:
    from paritylens.plans.registry import text_sql

    return SIX.replace("{text}", text_sql("output"))


def _all(spark, d):
    """Scores and channels of a log; three counts stand in for an embedding, and comparisons of both ends and lengths for a judge."""
    moded = plan.with_modes(samples(spark, d))
    trio = moded.where("arm in ('A', 'A_prime', 'B')")
    letters = lambda p: F.length(F.regexp_replace("output", p, "")).cast("double")
    vectors = trio.select(*BY, "input_id", "arm", F.array(letters("[^A-Za-z]"), letters("[^0-9]"), F.length("output").cast("double")).alias("embedding"))
    other = lambda f: (f("a", 8) != f("b", 8)).cast("double")
    part = lambda c: F.least(F.length("a"), F.length("b")) / F.greatest(F.length(c), F.lit(1))
    judged = modes.judged_pair(other(lambda c, n: F.left(F.col(c), F.lit(n))), other(lambda c, n: F.right(F.col(c), F.lit(n))), part("a"), part("b"))
    pairs = modes.positional_pairs(trio, [*BY, "input_id"]).select(*BY, "input_id", "side", judged.alias("judged"))
    return plan.all_scores(moded, BY, vectors, pairs)


@query(f"""WITH {_six_sql()}{SELECT}, nf AS (SELECT recording_id, channel, count(*) FILTER (WHERE flagged) AS n_flagged FROM flags GROUP BY ALL),
ch AS (SELECT recording_id, unnest(['mode_share', 'dispersion', 'novel_mode', 'nli_contradiction', 'nli_directional']) AS channel, n AS n_inputs, 0 AS n_blocked, NULL AS skipped FROM (SELECT recording_id, count(*) AS n FROM inp GROUP BY 1)
  UNION ALL SELECT recording_id, 'embedding', n_inputs, n_blocked, CASE WHEN skip THEN 'surface drift' END FROM gt)
SELECT recording_id, channel, n_inputs, n_blocked, skipped, coalesce(n_flagged, 0) AS n_flagged FROM ch LEFT JOIN nf USING (recording_id, channel)""")
def q4_detect_all_channels(spark, d):
    """Each of the six channels of every recording: inputs, those held back by the gate, why it was skipped, what it flagged."""
    scored, channels = _all(spark, d)
    flagged = plan.judged(scored, BY, 0.10)[0].groupBy("recording_id", "channel").agg(F.count_if("flagged").alias("n_flagged"))
    return channels.join(flagged, ["recording_id", "channel"], "left").withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))


@query(f"""WITH {_six_sql()}, sz AS (SELECT recording_id, input_id, least(count(*) FILTER (WHERE arm = 'A' AND error IS NULL), count(*) FILTER (WHERE arm = 'A_prime' AND error IS NULL), count(*) FILTER (WHERE arm = 'B' AND error IS NULL)) AS n FROM kept GROUP BY ALL),
nt AS (SELECT recording_id, 'dropped' AS note, count(*) FILTER (WHERE n = 0) AS n FROM sz GROUP BY 1 UNION ALL SELECT recording_id, 'short', count(*) FILTER (WHERE n > 0 AND n < {K}) FROM sz GROUP BY 1
  UNION ALL SELECT recording_id, 'gated', n_blocked FROM gt WHERE NOT skip UNION ALL SELECT recording_id, 'midnight', CASE WHEN floor(min(nullif(ts, 0)) / 86400) <> floor(max(nullif(ts, 0)) / 86400) THEN 1 ELSE 0 END FROM samples GROUP BY 1)
SELECT recording_id, note, n FROM nt WHERE n > 0""")
def q4_notes(spark, d):
    return plan.notes(samples(spark, d), K, _all(spark, d)[1])


@query(f"""WITH {MODED}{DISTANCES}{SELECT}, f AS (SELECT recording_id, input_id, stratum, count(*) AS n_channels, string_agg(channel, ',' ORDER BY channel) AS channels FROM flags WHERE flagged GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n_channels DESC, input_id) AS place FROM f QUALIFY place <= 25""")
def d8_top_findings(spark, d):
    found = fdr.findings(plan.judged(plan.scores(plan.with_modes(samples(spark, d)), BY), BY, 0.10)[0], BY)
    return fdr.top_findings(found, BY).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {MODED.replace("moded AS", "moded0 AS")}, moded AS (SELECT * REPLACE (regexp_replace(lower(mode), '[0-9]+', '#', 'g') AS mode) FROM moded0){DISTANCES}
SELECT recording_id, input_id, round(mode_share_t, 9) AS mode_share_t, round(mode_share_d, 9) AS mode_share_d, round(dispersion_t, 9) AS dispersion_t, round(dispersion_d, 9) AS dispersion_d, round(novel_mode_t, 9) AS novel_mode_t, round(novel_mode_d, 9) AS novel_mode_d FROM dist""")
def u4_clustered_distances(spark, d):
    """Distances over clusters of a predicate: the same but for case and numbers."""
    import re

    plain = lambda x: re.sub("[0-9]+", "#", x.lower())
    m = plan.with_modes(samples(spark, d)).where("arm in ('A', 'A_prime', 'B')")
    w = modes.clustered_distances(m, ["recording_id", "input_id"], lambda pairs: [plain(a) == plain(b) for a, b in pairs])
    return w.select("recording_id", "input_id", *(F.round(c, 9).alias(c) for c in w.columns if c not in ("recording_id", "input_id")))


# -- several pairings -------------------------------------------------------------


def _map_sql(pairs: dict) -> str:
    rows = ", ".join(f"('{p}', '{src}', '{dst}')" for p, arms in pairs.items() for src, dst in zip(arms, ("A", "A_prime", "B")))
    return f"pm AS (SELECT * FROM (VALUES {rows}) v(pairing, src, to_arm))"


DESIGN = f"""last AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY recording_id, input_id, sample_idx, arm ORDER BY line_no DESC) = 1),
tup AS (SELECT recording_id, input_id, sample_idx, count(DISTINCT arm) FILTER (WHERE arm IN ('A', 'A_prime', 'B', 'B_prime')) = 4 AS complete, count(*) FILTER (WHERE error IS NOT NULL AND error <> '') >= 4 AS failed FROM last GROUP BY ALL),
usable AS (SELECT l.* FROM last l JOIN tup t USING (recording_id, input_id, sample_idx) WHERE complete AND NOT failed AND error IS NULL), {_map_sql(pairings.DESIGN_R)},
moded AS (SELECT u.recording_id || '|' || pairing AS recording_id, input_id, to_arm AS arm, sample_idx, ord, line_no, output, {mode_sql('output')} AS mode, {shape_sql('output')} AS shape FROM usable u JOIN pm ON u.arm = pm.src)"""
FOUND = "fnd AS (SELECT split_part(recording_id, '|', 1) AS recording_id, split_part(recording_id, '|', 2) AS pairing, input_id, stratum, count(*) AS n_channels, string_agg(channel, ',' ORDER BY channel) AS channels FROM flags WHERE flagged GROUP BY ALL)"


@query(f"WITH {DESIGN}{DISTANCES}{SELECT}, {FOUND} SELECT * FROM fnd")
def f3_q7_design_r(spark, d):
    return plan.design_r(samples(spark, d))


@query(f"""WITH {DESIGN}{DISTANCES}{SELECT.replace("<= 0.1e0", "<= 0.5e0")}, {FOUND}
SELECT recording_id, input_id, CASE WHEN bool_or(pairing = 'primary') AND bool_or(pairing = 'reverse') THEN 'both' WHEN bool_or(pairing = 'primary') THEN 'primary_only' ELSE 'reverse_only' END AS side FROM fnd WHERE pairing IN ('primary', 'reverse') GROUP BY ALL""")
def j3_orientation(spark, d):
    """At q = 0.5, since recordings with four arms are too few inputs for less."""
    return pairings.orientation(plan.design_r(samples(spark, d), 0.5), BY)


DRIFTED = f"""{MODED.replace("moded AS", "moded0 AS")}, ids AS (SELECT recording_id, lead(recording_id) OVER (ORDER BY recording_id) AS nxt FROM (SELECT DISTINCT recording_id FROM samples)),
roles AS (SELECT recording_id, recording_id || '/' || nxt AS joint, 'p1.' AS phase FROM ids WHERE nxt IS NOT NULL UNION ALL SELECT nxt, recording_id || '/' || nxt, 'p2.' FROM ids WHERE nxt IS NOT NULL), {_map_sql(pairings.DRIFT)},
moded AS (SELECT joint || '|' || pairing AS recording_id, input_id, to_arm AS arm, sample_idx, ord, line_no, output, mode, shape FROM moded0 JOIN roles USING (recording_id) JOIN pm ON pm.src = phase || arm)"""


@query(f"WITH {DRIFTED}{DISTANCES}{SELECT} SELECT split_part(recording_id, '|', 1) AS recording_id, split_part(recording_id, '|', 2) AS pairing, count(DISTINCT input_id) AS n_inputs, count(DISTINCT input_id) FILTER (WHERE flagged) AS n_flagged FROM flags GROUP BY ALL")
def q10_drift_control(spark, d):
    """Every recording of the log against the next one: what changed between them and within the later one."""
    both = pairings.relabel(pairings.phases(plan.with_modes(samples(spark, d)), samples(spark, d)), pairings.DRIFT)
    by = ["recording_id", "pairing"]
    flagged, _, _ = plan.judged(plan.scores(both, by), by, 0.10)
    return flagged.groupBy(*by).agg(F.countDistinct("input_id").alias("n_inputs"), F.countDistinct(F.when(F.col("flagged"), F.col("input_id"))).alias("n_flagged"))


# -- repeats, queues and pairs ------------------------------------------------------


@query(f"""WITH {MODED}, f AS (SELECT recording_id, input_id, arm, arg_min(output, ROW(sample_idx, line_no)) AS first FROM moded GROUP BY ALL)
SELECT recording_id, input_id, arm, count(DISTINCT output) AS raw, count(DISTINCT mode) AS normalised, min(len(list_filter(range(1, least(length(output), length(first)) + 1), lambda i: substr(output, 1, i) = substr(first, 1, i)))) AS least_prefix
FROM moded JOIN f USING (recording_id, input_id, arm) GROUP BY ALL""")
def a30_repeats(spark, d):
    return diagnosis.repeats(log.usable(log.replayed(samples(spark, d))), ["recording_id", "input_id", "arm"]).withColumn("least_prefix", F.col("least_prefix").cast("long"))


@query("""WITH h AS (SELECT product_id AS input_id, substr(sha256('q|' || product_id), 1, 16) AS h, substr(sha256('q/side|' || product_id), 16, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS side FROM products)
SELECT row_number() OVER (ORDER BY h, input_id) AS place, input_id, CASE WHEN side THEN 'm1' ELSE 'm2' END AS "X", CASE WHEN side THEN 'm2' ELSE 'm1' END AS "Y" FROM h""")
def g16_blind_queue(spark, d):
    p = table(spark, d, "products").select(F.col("product_id").alias("input_id"), F.lit("m1").alias("left"), F.lit("m2").alias("right"))
    return judging.queue(p, "q").select(F.col("place").cast("long").alias("place"), "input_id", "X", "Y")


@query(f"""WITH {LAST}, pl AS (SELECT recording_id, input_id, arm, output, row_number() OVER (PARTITION BY recording_id, input_id, arm ORDER BY sample_idx, ord, line_no) AS place FROM usable)
SELECT a.recording_id, a.input_id, a.place FROM pl a JOIN pl b ON a.recording_id = b.recording_id AND a.input_id = b.input_id AND a.place = b.place AND a.arm = 'A' AND b.arm = 'A_prime' WHERE a.output = b.output""")
def d10_degenerate_repeats(spark, d):
    """Pairs of the baseline and its repeat whose two sides are the same text."""
    kept = log.usable(log.replayed(samples(spark, d))).where("arm in ('A', 'A_prime')")
    return modes.positional_pairs(kept, ["recording_id", "input_id"]).where("a = b").select("recording_id", "input_id", F.col("place").cast("long").alias("place"))


@query("""WITH r AS (SELECT recording_id, count(DISTINCT arm) AS n_arms, max(session_no) AS sessions FROM samples GROUP BY 1), f AS (SELECT *, sessions % 2 = 0 AS finished FROM r)
SELECT a.recording_id, b.recording_id AS other_id FROM f a JOIN f b ON a.n_arms IS NOT DISTINCT FROM b.n_arms AND a.recording_id <> b.recording_id AND NOT b.finished""")
def s14_in_flight_by_arms(spark, d):
    """Unfinished are here recordings whose last session has an odd number."""
    rec = samples(spark, d).groupBy("recording_id").agg(F.countDistinct("arm").alias("n_arms"), F.max("session_no").alias("sessions"))
    return log.in_flight(rec.withColumn("finished", F.col("sessions") % 2 == 0), ["n_arms"])


@query("""WITH c AS (SELECT recording_id, arm, count(*) AS n FROM samples GROUP BY ALL), a AS (SELECT recording_id, arm, CASE WHEN arm IN ('A', 'A_prime') THEN length(recording_id) % 3 WHEN n % 2 = 0 THEN n END AS seed, CASE WHEN n % 4 = 0 THEN n END AS sampling_seed FROM c),
v AS (SELECT recording_id, max(coalesce(sampling_seed, seed)) FILTER (WHERE arm = 'A') AS x, max(coalesce(sampling_seed, seed)) FILTER (WHERE arm = 'A_prime') AS y FROM a GROUP BY 1)
SELECT recording_id, 'A' AS arm, 'shared seed' AS warning FROM v WHERE x = y UNION ALL
SELECT a.recording_id, arm, CASE WHEN arm IN ('A', 'A_prime') THEN 'pinned baseline' ELSE 'pinned candidate' END FROM a JOIN v USING (recording_id) WHERE sampling_seed IS NOT NULL AND NOT (coalesce(x = y, false) AND arm IN ('A', 'A_prime'))""")
def f7_seed_warnings(spark, d):
    """Seeds stand in from lengths and counts, as the log keeps none."""
    n = samples(spark, d).groupBy("recording_id", "arm").agg(F.count(F.lit(1)).alias("n"))
    seed = F.when(F.col("arm").isin("A", "A_prime"), F.length("recording_id").cast("long") % 3).when(F.col("n") % 2 == 0, F.col("n"))
    return log.decoy_independence(n.select("recording_id", "arm", seed.alias("seed"), F.when(F.col("n") % 4 == 0, F.col("n")).alias("sampling_seed")))


# -- rows of the tool layer ------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 50000e0 END AS low, CASE WHEN c_custkey % 4 <> 0 THEN 150000e0 END AS high FROM customer)
SELECT k, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS items FROM c LEFT JOIN orders ON o_custkey = k AND (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice <= high) GROUP BY k""")
def j7_search_items(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.lit(50000.0)).alias("low"), F.when(F.col("c_custkey") % 4 != 0, F.lit(150000.0)).alias("high"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("ordinal"), F.col("o_orderkey").alias("id"))
    found = tools.search_items(c, o, "k", ["ordinal", "id"])
    return found.select("k", "n", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("items"))


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal AS annual_income, CAST(c_custkey % 900 AS DOUBLE) AS existing_debt, c_nationkey AS years_on_record FROM customer), q AS (SELECT *, round(existing_debt / CASE WHEN coalesce(annual_income, 0) = 0 THEN 1 ELSE annual_income END, 4) AS ratio FROM p)
SELECT id, ratio, years_on_record >= r_regionkey + 5 AND ratio <= 0.3e0 AS meets_criteria, r_name AS policy FROM q, (SELECT * FROM region ORDER BY r_regionkey LIMIT 1)""")
def j10_first_policy(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("annual_income"), (F.col("c_custkey") % 900).cast("double").alias("existing_debt"), F.col("c_nationkey").alias("years_on_record"))
    policies = table(spark, d, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("policy"), (F.col("r_regionkey") + 5).alias("min_years_on_record"), F.lit(0.3).alias("max_ratio"))
    return tools.evaluate_first(p, policies).select("id", "ratio", "meets_criteria", "policy")


@query("SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS owned FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j11_history_items(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("ordinal"), F.col("o_orderkey").alias("id"))
    h = tools.history_items(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", ["ordinal", "id"])
    return h.select("c_custkey", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("owned"))


@query("""SELECT order_id, loaded_at, p.lang IS NOT NULL AS known, CASE WHEN p.lang = 'en' THEN p.company LIKE '%a%' WHEN p.lang IS NOT NULL THEN p.company LIKE '%a%' END AS valid, CASE WHEN p.lang IS NOT NULL THEN true END AS stale_valid
FROM campaign_orders o LEFT JOIN (SELECT client_id, coalesce(lang, '') AS lang, company FROM clients) p USING (client_id)""")
def j12_verify(spark, d):
    docs = table(spark, d, "clients").select(F.col("client_id").alias("id"), F.coalesce("lang", F.lit("")).alias("kind"), F.col("company").like("%a%").alias("valid"))
    calls = table(spark, d, "campaign_orders").select("order_id", "loaded_at", "client_id")
    fresh = tools.verify(calls, docs, "client_id")
    stale = tools.verify(fresh.drop("kind").withColumnRenamed("valid", "fresh"), docs, "client_id", stale=True)
    return stale.select("order_id", "loaded_at", F.col("kind").isNotNull().alias("known"), F.col("fresh").alias("valid"), F.col("valid").alias("stale_valid"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, CAST('0x' || substr(sha256('7|' || o_orderkey), 1, 8) AS BIGINT) / 4294967295e0 AS u, substr(sha256('bucket|7|' || o_orderkey), 1, 2) AS b, sha256('order|7|' || o_orderkey) AS h FROM orders),
n AS (SELECT *, coalesce(lead(o_totalprice) OVER w, first_value(o_totalprice) OVER w) AS other FROM o WINDOW w AS (PARTITION BY b ORDER BY h, o_orderkey))
SELECT o_orderkey, CASE WHEN u < 0.3e0 THEN other ELSE o_totalprice END AS o_totalprice, u < 0.3e0 AS degraded FROM n""")
def g7_degraded_reads(spark, d):
    return tools.degraded(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 0.3, 7, "o_orderkey", "o_totalprice")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CAST('0x' || substr(sha256('5|' || o_orderkey), 1, 8) AS BIGINT) / 4294967295e0 < 0.2e0 AS swap, lead(o_orderkey) OVER (PARTITION BY substr(sha256('bucket|5|' || o_orderkey), 1, 2) ORDER BY sha256('order|5|' || o_orderkey), o_orderkey) AS nxt,
  first_value(o_orderkey) OVER (PARTITION BY substr(sha256('bucket|5|' || o_orderkey), 1, 2) ORDER BY sha256('order|5|' || o_orderkey), o_orderkey) AS top FROM orders)
SELECT o_custkey, string_agg(CAST(CASE WHEN swap THEN coalesce(nxt, top) ELSE o_orderkey END AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM l GROUP BY 1""")
def g7_mixed_lists(spark, d):
    """What a customer's list of orders shows when a fifth of its items are another customer's."""
    return tools.mixed_lists(table(spark, d, "orders").select("o_custkey", "o_orderkey"), 0.2, 5, "o_custkey", "o_orderkey").select("o_custkey", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT level, noise FROM (VALUES (1, 0.1e0), (2, 0.2e0), (3, 0.3e0)) v(level, noise)")
def g7_severity_ladder(spark, d):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(tools.DEGRADED_LADDER)], "level int, noise double")


# -- studies ---------------------------------------------------------------------------

_HASH = plan.config_hash({"predicate": "exact-match"}, {"k": K, "q": 0.1}, "samples")


@query(f"""WITH {MODED}{DISTANCES}{SELECT}, {LABELS}, f AS (SELECT recording_id, channel, flagged, coalesce(fired, false) AS fired FROM flags LEFT JOIN fired USING (recording_id, input_id)),
m AS (SELECT recording_id, channel, count(*) AS n_inputs, count(*) FILTER (WHERE flagged) AS n_flagged, count(*) FILTER (WHERE fired) AS n_fired, count(*) FILTER (WHERE flagged AND fired) AS tp FROM f GROUP BY ALL)
SELECT *, round((n_flagged - tp) / nullif(n_flagged, 0), 9) AS realised_fdr, round(tp / nullif(n_fired, 0), 9) AS recall, 'r1' AS run_id, '{_HASH}' AS config_hash FROM m""")
def q9_graded_matrix(spark, d):
    m = studies.graded_matrix(samples(spark, d), table(spark, d, "activation"), {"run_id": "r1", "config_hash": _HASH})
    return m.withColumn("realised_fdr", F.round("realised_fdr", 9)).withColumn("recall", F.round("recall", 9))


@query(f"WITH {MODED}{DISTANCES}, {LABELS} SELECT recording_id, channel, input_id, coalesce(fired, false) AS fired, round(target, 9) AS target, round(decoy, 9) AS decoy FROM sc LEFT JOIN fired USING (recording_id, input_id)")
def q11_diagnosis_rows(spark, d):
    return studies.diagnosis_rows(samples(spark, d), table(spark, d, "activation")).withColumn("target", F.round("target", 9)).withColumn("decoy", F.round("decoy", 9))


_CELLS = [("refusal", 0.5), ("refusal", 1.0), ("verbosity", 1.0)]
_VALUES = ", ".join(f"('{n}', {s}e0, '{faults.cell_id('F', n, s, 'B2')}', '{faults.REFUSAL_TEXT.replace(chr(39), chr(39) * 2) if n == 'refusal' else faults.PREAMBLE}')" for n, s in _CELLS)
TITRATED = f"""{LAST}, cl AS (SELECT * FROM (VALUES {_VALUES}) v(fault, severity, cell, said)),
inj AS (SELECT recording_id || '|' || fault || '|' || severity AS recording_id, input_id, arm, sample_idx, ord, line_no, output AS raw, fault, said,
  arm = 'B' AND trim(output) <> '' AND CAST('0x' || substr(sha256('3|' || cell || '|' || input_id), 1, 8) AS BIGINT) / 4294967295e0 < 0.5e0 AS hit FROM usable, cl),
outp AS (SELECT *, CASE WHEN NOT hit THEN raw WHEN fault = 'refusal' THEN said ELSE said || raw END AS output FROM inj),
moded AS (SELECT recording_id, input_id, arm, sample_idx, ord, line_no, output, {mode_sql('output')} AS mode, {shape_sql('output')} AS shape FROM outp)"""


@query(f"""WITH {TITRATED}{DISTANCES}{SELECT}, t AS (SELECT recording_id, input_id, bool_or(hit) AS fired FROM inj GROUP BY ALL), f AS (SELECT DISTINCT recording_id, input_id FROM flags WHERE flagged),
g AS (SELECT t.recording_id, count(f.input_id) AS n_flagged, count(*) FILTER (WHERE fired) AS n_fired, count(f.input_id) FILTER (WHERE fired) AS tp FROM t LEFT JOIN f ON f.recording_id = t.recording_id AND f.input_id = t.input_id GROUP BY 1)
SELECT split_part(recording_id, '|', 1) AS recording_id, split_part(recording_id, '|', 2) AS fault, CAST(split_part(recording_id, '|', 3) AS DOUBLE) AS severity, n_flagged, n_fired, tp, round(tp / nullif(n_fired, 0), 9) AS recall FROM g""")
def q12_titration(spark, d):
    t = studies.titrate(samples(spark, d), _CELLS, 0.10, 0.5, 3)
    return t.select("recording_id", "fault", "severity", "n_flagged", "n_fired", "tp", F.round("recall", 9).alias("recall"))


@query(f"""WITH {DESIGN}{DISTANCES}{SELECT}, {FOUND}, i AS (SELECT DISTINCT recording_id, input_id FROM fnd), h AS (SELECT *, substr(sha256('c|' || input_id), 1, 16) AS h, substr(sha256('c/side|' || input_id), 16, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS side FROM i)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY h, input_id) AS place, input_id, CASE WHEN side THEN 'A' ELSE 'B' END AS "X", CASE WHEN side THEN 'B' ELSE 'A' END AS "Y" FROM h""")
def q13_campaign_queue(spark, d):
    return studies.campaign_queue(samples(spark, d), "c").select("recording_id", F.col("place").cast("long").alias("place"), "input_id", "X", "Y")


# -- generators and the catalogue of prompt edits ---------------------------------------


@query("SELECT name AS edit, round(rung / 3e0, 9) AS severity, rung FROM (VALUES ('line_injected', 1), ('last_line_dropped', 1), ('lines_resurrected', 2), ('first_lines_dropped', 2)) v(name, rung)")
def u11_prompt_edits(spark, d):
    return spark.createDataFrame([(e.name, round(e.severity, 9), e.rung) for e in faults.PROMPT_EDITS.values()], "edit string, severity double, rung int")


@query(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, l, 'last_line_dropped' AS edit, list_slice(l, 1, greatest(len(l) - 1, 0)) AS a FROM p UNION ALL
SELECT doc_id, l, 'first_lines_dropped', list_slice(l, 4, len(l)) FROM p)
SELECT doc_id, edit, len(list_distinct(list_filter(l, lambda x: NOT list_contains(a, x)))) AS n_removed FROM e""")
def u11_edited_prompts(spark, d):
    """What two of the edits take from the lines of every document."""
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    return faults.edited(p).where("edit in ('last_line_dropped', 'first_lines_dropped')").select("doc_id", "edit", F.col("n_removed").cast("long").alias("n_removed"))


@query("""WITH t AS (SELECT range AS i, CASE range % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'policy' ELSE 'mixed' END AS kind, (SELECT list(product_id ORDER BY product_id) FROM products) AS p, (SELECT list(client_id ORDER BY client_id) FROM clients) AS c FROM range(5000))
SELECT 'sales-' || kind || '-' || printf('%03d', i) AS input_id, kind, CASE kind WHEN 'lookup' THEN 'What is the status of ' || p[i % len(p) + 1] || '?' WHEN 'policy' THEN 'What holds for ' || c[i % len(c) + 1] || '?'
  ELSE 'For ' || c[i % len(c) + 1] || ', what of ' || p[i % len(p) + 1] || '?' END AS text, 'user' || i % 7 AS principal FROM t""")
def g12_corpus(spark, d):
    """Requests about the products and clients, which are two fixed lists."""
    ids = lambda name, c: [r[0] for r in table(spark, d, name).select(c).orderBy(c).collect()]
    templates = [("lookup", "What is the status of {product}?"), ("policy", "What holds for {client}?"), ("mixed", "For {client}, what of {product}?")]
    return generators.corpus(spark, templates, {"product": ids("products", "product_id"), "client": ids("clients", "client_id")}, 5000, "sales", users=7)


_SEEDS = "SELECT product_id AS seed_id, designation AS subject, CAST(row_number() OVER (ORDER BY product_id) AS VARCHAR) AS number FROM products"


@query(f"""WITH s AS ({_SEEDS}), x AS (SELECT *, shape, category FROM s, (VALUES ('short'), ('steps')) v(shape), (VALUES ('same'), ('number'), ('register')) c(category)),
r AS (SELECT *, CASE shape WHEN 'short' THEN subject || ': ' || number ELSE '1. ' || subject || chr(10) || '2. ' || number END AS a, CASE shape WHEN 'short' THEN CASE category WHEN 'register' THEN 'dear ' || subject ELSE subject END || ': ' || CASE category WHEN 'number' THEN number || '0' ELSE number END
  ELSE '1. ' || CASE category WHEN 'register' THEN 'dear ' || subject ELSE subject END || chr(10) || '2. ' || CASE category WHEN 'number' THEN number || '0' ELSE number END END AS b FROM x)
SELECT seed_id, shape, category, CASE category WHEN 'same' THEN 'PRESERVING' WHEN 'number' THEN 'BREAKING' ELSE 'REGISTER' END AS relation, a, b FROM r""")
def g13_factorial(spark, d):
    w = Window.orderBy("product_id")  # a fixed list of 72
    seeds = table(spark, d, "products").select(F.col("product_id").alias("seed_id"), F.col("designation").alias("subject"), F.row_number().over(w).cast("string").alias("number"))
    edits = {"same": ("PRESERVING", {}), "number": ("BREAKING", {"number": F.concat("number", F.lit("0"))}), "register": ("REGISTER", {"subject": F.concat(F.lit("dear "), "subject")})}
    return generators.factorial(seeds, {"short": "{subject}: {number}", "steps": "1. {subject}\n2. {number}"}, edits)


@query()
def g11_pack_entities(spark, d):
    """Entities of an invented domain with their owners and events; no SQL, as a pack is no function of a table."""
    p = generators.pack(spark, {"principal": "AP", "entity": "AC", "names": ["Ada", "Ben", "Cleo"], "statuses": ["open", "held", "closed"], "products": ["basic", "plus"], "documents": ["id", "bill"]}, 5000)
    n = p["events"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("amount").alias("amount"))
    return p["entities"].join(p["principals"].select(F.col("id").alias("principal_id"), "name"), "principal_id").join(n, F.col("id") == F.col("entity_id")).drop("entity_id")


@query()
def g15_null_design_blocks(spark, d):
    """All nine blocks of simulated cells, 50 repetitions each."""
    return simulation.summary(simulation.cells(spark, reps=50))


@query(f"""WITH {MODED}{DISTANCES}{SELECT}, ln AS (SELECT recording_id, string_agg('  ' || channel || ' [' || eff_stratum || ']: ' || n_discoveries || ' flagged, ' || CASE WHEN estimate IS NULL THEN 'no inputs' WHEN n_discoveries > 0 THEN 'flagged' WHEN separated THEN 'under the floor' WHEN estimate < 0.5e0 THEN 'partly separated' ELSE 'no separation' END, chr(10) ORDER BY channel, eff_stratum) AS l
  FROM sel LEFT JOIN best USING (recording_id, channel, eff_stratum) GROUP BY 1),
f AS (SELECT recording_id, input_id, count(*) AS n_channels, string_agg(channel, ',' ORDER BY channel) AS channels FROM flags WHERE flagged GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n_channels DESC, input_id) AS place FROM f),
fs AS (SELECT recording_id, count(*) AS n, string_agg('  ' || input_id || ' (' || channels || ')', chr(10) ORDER BY place) FILTER (WHERE place <= 25) AS t FROM p GROUP BY 1)
SELECT recording_id, coalesce(n, 0) || ' inputs flagged at q = 0.1' || CASE WHEN n IS NULL THEN chr(10) || 'nothing can be reported below 10 inputs' ELSE '' END || chr(10) || 'checks' || chr(10) || l || CASE WHEN n IS NULL THEN '' ELSE chr(10) || 'findings' || chr(10) || t || CASE WHEN n > 25 THEN chr(10) || '  and ' || (n - 25) || ' more' ELSE '' END END AS text
FROM ln LEFT JOIN fs USING (recording_id)""")
def q15_report_text(spark, d):
    """The report of every recording as text; its lists are cut at 25 findings."""
    flagged, sel, best = plan.judged(plan.scores(plan.with_modes(samples(spark, d)), BY), BY, 0.10)
    return plan.report_text(plan.report(flagged, sel, best, BY, 0.10), BY)
