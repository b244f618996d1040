"""Queries of the detector: modes, distances, thresholds, rules, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylens.functions import text as X
from paritylens.operators import diagnosis, fdr, grading, log, modes, pairings
from paritylens.operators.conformance import KINDS
from paritylens.plans import detect as plan
from paritylens.plans.log_queries import LABELS, samples
from paritylens.plans.registry import DISTANCES, LAST, MODED, SELECT, literal, mode_sql, query, table, text_sql, words_sql

BY = ["recording_id"]
GROUP = ["recording_id", "channel", "eff_stratum"]
ALL = f"WITH {MODED}{DISTANCES}{SELECT} "


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if c in cols else F.col(c) for c in df.columns))


def _moded(spark, d):
    return plan.with_modes(samples(spark, d))


EVENTS = """WITH ev AS (SELECT user_id AS input_id, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A_prime' ELSE 'B' END AS arm,
  CASE WHEN event_id % 3 = 2 AND user_id % 5 = 0 THEN 'error' ELSE event_type END AS mode FROM events),
mc AS (SELECT input_id, mode, count(*) FILTER (WHERE arm = 'A') AS ca, count(*) FILTER (WHERE arm = 'A_prime') AS cp, count(*) FILTER (WHERE arm = 'B') AS cb FROM ev GROUP BY ALL),
mx AS (SELECT *, sum(ca) OVER w AS na, sum(cp) OVER w AS np, sum(cb) OVER w AS nb FROM mc WINDOW w AS (PARTITION BY input_id)),
s AS (SELECT input_id, CAST(sum(abs(ca * nb - cb * na)) AS DOUBLE) / CAST(2 * na * nb AS DOUBLE) AS target, CAST(sum(abs(ca * np - cp * na)) AS DOUBLE) / CAST(2 * na * np AS DOUBLE) AS decoy
  FROM mx WHERE na > 0 AND np > 0 AND nb > 0 GROUP BY input_id, na, np, nb),
sc AS (SELECT 'events' AS recording_id, input_id, 'events' AS stratum, 'mode_share' AS channel, target, decoy FROM s)"""


@query(EVENTS + SELECT + "SELECT input_id, round(target, 9) AS target, round(decoy, 9) AS decoy, threshold_key / 1e9 AS threshold, flagged FROM flags")
def detect_events(spark, d):
    """Which users changed their mix of events, at q = 0.10; the arm is event_id % 3, and every fifth user's candidate is all errors."""
    arm = F.element_at(F.array(F.lit("A"), F.lit("A_prime"), F.lit("B")), (F.col("event_id") % 3 + 1).cast("int"))
    mode = F.when((F.col("event_id") % 3 == 2) & (F.col("user_id") % 5 == 0), "error").otherwise(F.col("event_type"))
    s = table(spark, d, "events").select(F.lit("events").alias("recording_id"), F.col("user_id").alias("input_id"), arm.alias("arm"), mode.alias("mode"))
    keys = ["recording_id", "input_id"]
    wide = modes.distances(modes.mode_counts(s, keys), keys)
    sc = modes.long_scores(wide.withColumn("stratum", F.lit("events")), [*keys, "stratum"], ["mode_share"])
    flagged, _, _ = plan.judged(sc, BY, 0.10)
    return flagged.select("input_id", F.round("target", 9).alias("target"), F.round("decoy", 9).alias("decoy"), (F.col("threshold_key") / F.lit(1e9)).alias("threshold"), "flagged")


@query(f"WITH {MODED}, c AS (SELECT recording_id, input_id, arm, mode, count(*) AS n FROM moded GROUP BY ALL) SELECT recording_id, input_id, arm, n, round(n / sum(n) OVER (PARTITION BY recording_id, input_id, arm), 9) AS share FROM c")
def a1_mode_shares(spark, d):
    return _rounded(modes.mode_shares(_moded(spark, d), ["recording_id", "input_id"]).drop("mode"), "share")


@query(f"WITH {MODED}{DISTANCES} SELECT recording_id, input_id, CAST(na AS BIGINT) AS na, CAST(np AS BIGINT) AS np, CAST(nb AS BIGINT) AS nb, n_modes, round(mode_share_t, 9) AS mode_share_t, round(mode_share_d, 9) AS mode_share_d, round(dispersion_t, 9) AS dispersion_t, round(dispersion_d, 9) AS dispersion_d, round(novel_mode_t, 9) AS novel_mode_t, round(novel_mode_d, 9) AS novel_mode_d, round(a, 9) AS dispersion_a, round(p, 9) AS dispersion_p, round(b, 9) AS dispersion_b FROM dist")
def a2_a5_distances(spark, d):
    keys = ["recording_id", "input_id"]
    w = modes.distances(modes.mode_counts(_moded(spark, d), keys), keys)
    return _rounded(w, *[c for c in w.columns if c not in (*keys, "na", "np", "nb", "n_modes")])


DRIFT = rf""",
tok AS (SELECT recording_id, input_id, arm, unnest(regexp_extract_all(lower({text_sql('output')}), '[\p{{L}}\p{{N}}_]+')) AS word FROM usable),
tc AS (SELECT recording_id, input_id, word, count(*) FILTER (WHERE arm = 'A') AS ca, count(*) FILTER (WHERE arm = 'A_prime') AS cp, count(*) FILTER (WHERE arm = 'B') AS cb FROM tok GROUP BY ALL),
dr AS (SELECT recording_id, input_id, 1e0 - coalesce(CAST(sum(least(ca, cb)) AS DOUBLE) / nullif(CAST(sum(greatest(ca, cb)) AS DOUBLE), 0), 1) AS drift_t, 1e0 - coalesce(CAST(sum(least(ca, cp)) AS DOUBLE) / nullif(CAST(sum(greatest(ca, cp)) AS DOUBLE), 0), 1) AS drift_d FROM tc GROUP BY ALL)"""


def _drift(spark, d):
    return plan.surface_drift(log.usable(log.replayed(samples(spark, d))), BY)


@query(f"WITH {LAST}{DRIFT} SELECT recording_id, input_id, round(drift_t, 9) AS drift_t, round(drift_d, 9) AS drift_d, drift_t <= 0.25e0 AS allowed FROM dr")
def a6_a7_surface_drift(spark, d):
    return _rounded(_drift(spark, d).withColumn("allowed", F.col("drift_t") <= 0.25), "drift_t", "drift_d")


VECTORS = """v AS (SELECT label AS input_id, CASE vec_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A_prime' ELSE 'B' END AS arm, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT input_id, arm, unnest(range(len(e))) AS dim, unnest(e) / sqrt(list_sum(list_transform(e, lambda x: x * x))) AS x FROM v),
mean AS (SELECT input_id, dim, avg(x) FILTER (WHERE arm = 'A') AS a, avg(x) FILTER (WHERE arm = 'A_prime') AS p, avg(x) FILTER (WHERE arm = 'B') AS b FROM u GROUP BY ALL),
dots AS (SELECT input_id, sum(a * a) AS aa, sum(p * p) AS pp, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * p) AS ap FROM mean GROUP BY 1),
far AS (SELECT input_id, 1 - ab / sqrt(aa * bb) AS embedding_t, 1 - ap / sqrt(aa * pp) AS embedding_d FROM dots)"""


def _vectors(spark, d):
    arm = F.element_at(F.array(F.lit("A"), F.lit("A_prime"), F.lit("B")), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, d, "embeddings").select(F.col("label").alias("input_id"), arm.alias("arm"), "embedding")


@query(f"WITH {VECTORS} SELECT input_id, round(embedding_t, 6) AS embedding_t, round(embedding_d, 6) AS embedding_d FROM far")
def a8_centroid_distance(spark, d):
    s = modes.centroid_distance(_vectors(spark, d), ["input_id"])
    return s.select("input_id", F.round("embedding_t", 6).alias("embedding_t"), F.round("embedding_d", 6).alias("embedding_d"))


@query(f"""WITH {VECTORS}, g AS (SELECT *, (input_id % 4) / 10e0 AS drift_t, count(*) FILTER (WHERE (input_id % 4) / 10e0 > 0.25e0) OVER () * 2 > count(*) OVER () AS skipped FROM far)
SELECT input_id, skipped, drift_t <= 0.25e0 AS allowed, round(CASE WHEN drift_t > 0.25e0 THEN 0 ELSE embedding_t END, 6) AS embedding_t, round(CASE WHEN drift_t > 0.25e0 THEN 0 ELSE embedding_d END, 6) AS embedding_d FROM g""")
def a9_gated_embedding(spark, d):
    s = modes.centroid_distance(_vectors(spark, d), ["input_id"]).withColumn("recording_id", F.lit("e")).withColumn("drift_t", (F.col("input_id") % 4) / F.lit(10.0))
    return modes.gate(s, ["recording_id"]).select("input_id", "skipped", "allowed", F.round("embedding_t", 6).alias("embedding_t"), F.round("embedding_d", 6).alias("embedding_d"))


@query(f"WITH {MODED}{DISTANCES} SELECT recording_id, input_id, stratum FROM strata")
def a10_strata(spark, d):
    return modes.modal_shape(_moded(spark, d), ["recording_id", "input_id"], F.col("shape"))


@query(f"""WITH {MODED}{DISTANCES}, j AS (SELECT recording_id, input_id, sum(ca) AS a, sum(cp) AS p, sum(cb) AS b, count(*) FILTER (WHERE ca + cb > 0) AS mt, count(*) FILTER (WHERE ca + cp > 0) AS md FROM mc GROUP BY ALL)
SELECT recording_id, 2 * count(*) AS clusterings, CAST(sum(2 * a + b + p) AS BIGINT) AS samples_clustered, CAST(sum(mt + md) AS BIGINT) AS distinct_modes FROM j WHERE a > 0 AND p > 0 AND b > 0 GROUP BY 1""")
def a16_costs(spark, d):
    return modes.costs(modes.mode_counts(_moded(spark, d), ["recording_id", "input_id"]), BY)


def _scored(spark, d):
    return plan.scores(_moded(spark, d), BY)


@query(ALL + "SELECT recording_id, channel, eff_stratum, k AS score_key, CAST(nt AS BIGINT) AS nt, CAST(nd AS BIGINT) AS nd, round(est, 9) AS est FROM ce")
def e1_e2_w1_cuts(spark, d):
    eff = fdr.effective_strata(_scored(spark, d), ["recording_id", "channel"])
    return _rounded(fdr.cuts(eff, GROUP).drop("at_target"), "est")


@query(ALL + "SELECT recording_id, channel, eff_stratum, threshold_key, n_discoveries, round(fdr_hat, 9) AS fdr_hat FROM sel")
def e3_selections(spark, d):
    return _rounded(plan.judged(_scored(spark, d), BY, 0.10)[1], "fdr_hat")


@query(ALL + "SELECT recording_id, channel, eff_stratum, input_id, flagged FROM flags")
def e4_e6_e7_flags(spark, d):
    return plan.judged(_scored(spark, d), BY, 0.10)[0].select(*GROUP, "input_id", "flagged")


@query(ALL + "SELECT recording_id, channel, eff_stratum, cut_key, CAST(targets_above AS BIGINT) AS targets_above, CAST(decoys_above AS BIGINT) AS decoys_above, round(estimate, 9) AS estimate, separated FROM best")
def e5_best_cuts(spark, d):
    return _rounded(plan.judged(_scored(spark, d), BY, 0.10)[2], "estimate")


@query(f"""WITH {MODED}{DISTANCES.replace("sc AS (SELECT recording_id, input_id, stratum, channel, target, decoy FROM", "sc0 AS (SELECT recording_id, input_id, stratum, channel, target, decoy FROM")},
sg AS (SELECT recording_id, input_id, stratum, 'nli_directional' AS channel, CASE WHEN length(input_id) % 2 = 0 THEN target ELSE -target END AS target, decoy FROM sc0 WHERE channel = 'mode_share'),
sc AS (SELECT recording_id, input_id, stratum, channel, abs(target) AS target, abs(decoy) AS decoy, target AS signed FROM sg){SELECT} SELECT recording_id, input_id, round(signed, 9) AS target, flagged FROM flags""")
def e8_signed_channel(spark, d):
    """A two-tailed channel is selected by size and reported with its sign."""
    s = _scored(spark, d).where("channel = 'mode_share'").withColumn("channel", F.lit("nli_directional"))
    s = s.withColumn("target", F.when(F.length("input_id") % 2 == 0, F.col("target")).otherwise(-F.col("target")))
    return _rounded(plan.judged(s, BY, 0.10)[0].select("recording_id", "input_id", "target", "flagged"), "target")


COMPETE = """, w AS (SELECT *, greatest(tk, dk) AS wk, tk > dk AS win FROM eff),
wc AS (SELECT recording_id, channel, eff_stratum, wk, count(*) FILTER (WHERE win) AS w, count(*) FILTER (WHERE NOT win) AS l FROM w GROUP BY ALL),
wr AS (SELECT *, sum(w) OVER z AS nw, sum(l) OVER z AS nl FROM wc WINDOW z AS (PARTITION BY recording_id, channel, eff_stratum ORDER BY wk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
wp AS (SELECT * FROM wr WHERE nw > 0 AND CAST(1 + nl AS DOUBLE) / CAST(greatest(nw, 1) AS DOUBLE) <= 0.1e0 QUALIFY row_number() OVER (PARTITION BY recording_id, channel, eff_stratum ORDER BY nw DESC, wk DESC) = 1)"""


@query(ALL.rstrip() + COMPETE + "SELECT g.recording_id, g.channel, g.eff_stratum, wk AS threshold_key, CAST(coalesce(nw, 0) AS BIGINT) AS n_discoveries, round((1 + nl) / greatest(nw, 1), 9) AS fdr_hat FROM grp g LEFT JOIN wp USING (recording_id, channel, eff_stratum)")
def e9_e11_competition(spark, d):
    eff = fdr.effective_strata(_scored(spark, d), ["recording_id", "channel"])
    return _rounded(fdr.competition(eff, GROUP, 0.10)[0], "fdr_hat")


FOUR = f"""last AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY recording_id, input_id, sample_idx, arm ORDER BY line_no DESC) = 1),
tup AS (SELECT recording_id, input_id, sample_idx, count(DISTINCT arm) FILTER (WHERE arm IN ('A', 'A_prime', 'B', 'B_prime')) = 4 AS complete, count(*) FILTER (WHERE error IS NOT NULL AND error <> '') >= 4 AS failed FROM last GROUP BY ALL),
usable AS (SELECT l.* FROM last l JOIN tup t USING (recording_id, input_id, sample_idx) WHERE complete AND NOT failed AND error IS NULL),
fm AS (SELECT recording_id, input_id, arm, {mode_sql('output')} AS mode FROM usable),
fc AS (SELECT recording_id, input_id, mode, count(*) FILTER (WHERE arm = 'A') AS a, count(*) FILTER (WHERE arm = 'A_prime') AS p, count(*) FILTER (WHERE arm = 'B') AS b, count(*) FILTER (WHERE arm = 'B_prime') AS q FROM fm GROUP BY ALL),
fx AS (SELECT *, sum(a) OVER w AS na, sum(p) OVER w AS np, sum(b) OVER w AS nb, sum(q) OVER w AS nq FROM fc WINDOW w AS (PARTITION BY recording_id, input_id)),
fd AS (SELECT recording_id, input_id, CAST(sum(abs(a * nb - b * na)) AS DOUBLE) / CAST(2 * na * nb AS DOUBLE) AS target, CAST(sum(abs(a * np - p * na)) AS DOUBLE) / CAST(2 * na * np AS DOUBLE) AS near,
  CAST(sum(abs(b * nq - q * nb)) AS DOUBLE) / CAST(2 * nb * nq AS DOUBLE) AS far FROM fx WHERE na > 0 AND np > 0 AND nb > 0 AND nq > 0 GROUP BY recording_id, input_id, na, np, nb, nq)"""


def _pairings(spark, d):
    four = plan.with_modes(samples(spark, d), ("A", "A_prime", "B", "B_prime"))
    return plan.scores(pairings.relabel(four, pairings.DESIGN_R), ["recording_id", "pairing"])


@query(f"""WITH {FOUR}, k AS (SELECT recording_id, round_even(target * 1e9, 0) AS k, 1 AS t, 0 AS d FROM fd UNION ALL SELECT recording_id, round_even(near * 1e9, 0), 0, 1 FROM fd UNION ALL SELECT recording_id, round_even(far * 1e9, 0), 0, 1 FROM fd),
g AS (SELECT recording_id, CAST(k AS BIGINT) AS score_key, sum(t) AS t, sum(d) AS d FROM k GROUP BY ALL),
c AS (SELECT recording_id, score_key, sum(t) OVER w AS nt, sum(d) OVER w AS nd FROM g WINDOW w AS (PARTITION BY recording_id ORDER BY score_key DESC))
SELECT recording_id, score_key, CAST(nt AS BIGINT) AS nt, CAST(nd AS BIGINT) AS nd, round((1 + nd / 2e0) / greatest(nt, 1), 9) AS est FROM c""")
def e12_ratio_estimate(spark, d):
    s = _pairings(spark, d).where("channel = 'mode_share'")
    both = pairings.near_and_far(s.where("pairing = 'primary'"), s.where("pairing = 'reverse'"), ["recording_id", "channel", "input_id"])
    return _rounded(fdr.cuts(both, ["recording_id"], fold=[], divisor=2).select("recording_id", "score_key", "nt", "nd", "est"), "est")


@query(ALL + "SELECT recording_id, channel, count(*) FILTER (WHERE tk <> dk) AS m, round(count(*) FILTER (WHERE tk > dk) / nullif(count(*) FILTER (WHERE tk <> dk), 0), 9) AS share FROM eff GROUP BY ALL")
def e14_sign_statistic(spark, d):
    return _rounded(fdr.sign_statistic(_scored(spark, d), ["recording_id", "channel"]), "share")


@query(ALL + """SELECT recording_id, channel, eff_stratum, 10 AS floor, CASE WHEN estimate IS NULL THEN 'no inputs' WHEN n_discoveries > 0 THEN 'flagged' WHEN separated THEN 'under the floor' WHEN estimate < 0.5e0 THEN 'partly separated' ELSE 'no separation' END AS reading
FROM sel LEFT JOIN best USING (recording_id, channel, eff_stratum)""")
def e15_e16_readings(spark, d):
    _, sel, best = plan.judged(_scored(spark, d), BY, 0.10)
    return sel.join(best, GROUP, "left").select(*GROUP, F.lit(fdr.floor_of(0.10)).alias("floor"), fdr.reading(0.10).alias("reading"))


@query(ALL + """SELECT recording_id, channel, eff_stratum, round(estimate, 9) AS estimate FROM best QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY estimate, list_position(['mode_share', 'dispersion', 'novel_mode'], channel), eff_stratum) = 1""")
def e17_closest_check(spark, d):
    return _rounded(fdr.closest(plan.judged(_scored(spark, d), BY, 0.10)[2], BY, modes.CHANNELS), "estimate")


@query(ALL + "SELECT recording_id, input_id, stratum, count(*) AS n_channels, string_agg(channel, ',' ORDER BY channel) AS channels FROM flags WHERE flagged GROUP BY ALL")
def d8_findings(spark, d):
    return fdr.findings(plan.judged(_scored(spark, d), BY, 0.10)[0], BY)


@query(ALL.rstrip() + f""", {LABELS}, f AS (SELECT recording_id, input_id FROM flags WHERE flagged GROUP BY ALL), t AS (SELECT recording_id, input_id FROM fired WHERE fired)
SELECT recording_id, count(f.input_id) AS n_flagged, count(t.input_id) AS n_fired, count(*) FILTER (WHERE f.input_id IS NOT NULL AND t.input_id IS NOT NULL) AS tp,
  round((count(f.input_id) - count(*) FILTER (WHERE f.input_id IS NOT NULL AND t.input_id IS NOT NULL)) / nullif(count(f.input_id), 0), 9) AS realised_fdr,
  round(count(*) FILTER (WHERE f.input_id IS NOT NULL AND t.input_id IS NOT NULL) / nullif(count(t.input_id), 0), 9) AS recall
FROM (SELECT *, input_id AS i FROM f) f FULL JOIN (SELECT *, input_id AS i FROM t) t USING (recording_id, i) GROUP BY recording_id""")
def j4_a28_grades(spark, d):
    flagged = plan.judged(_scored(spark, d), BY, 0.10)[0].where("flagged")
    return _rounded(grading.grade(flagged, log.touched(table(spark, d, "activation")), BY), "realised_fdr", "recall")


@query(f"WITH {FOUR} SELECT recording_id, input_id, round(target, 9) AS target, round(near, 9) AS near, round(far, 9) AS far FROM fd")
def j5_aligned_pairings(spark, d):
    s = _pairings(spark, d).where("channel = 'mode_share'").select("recording_id", "pairing", "input_id", "target", "decoy")
    a = s.where("pairing = 'primary'").drop("pairing")
    b = s.where("pairing = 'reverse'").select("recording_id", "input_id", F.col("decoy").alias("far"))
    j = pairings.aligned(a, b, ["recording_id", "input_id"])
    return j.select("recording_id", "input_id", F.round("target", 9).alias("target"), F.round("decoy", 9).alias("near"), F.round("far", 9).alias("far"))


DECIDED = f"""dec AS (SELECT recording_id, input_id, arm, coalesce(nullif(regexp_extract(output, '\\b(APPROVE|DECLINE|ESCALATE)\\b', 1), ''), 'NONE') AS decision FROM usable),
maj AS (SELECT recording_id, input_id, arm, decision FROM (SELECT recording_id, input_id, arm, decision, count(*) AS n FROM dec GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY recording_id, input_id, arm ORDER BY n DESC, decision) = 1)"""


def _decided(spark, d):
    return diagnosis.decisions(log.usable(log.replayed(samples(spark, d))))


@query(f"WITH {LAST}, {DECIDED} SELECT recording_id, input_id, arm, decision FROM maj")
def a11_x13_majorities(spark, d):
    return diagnosis.majorities(_decided(spark, d), ["recording_id", "input_id"])


@query(f"""WITH {LAST}, {DECIDED}, {LABELS}, p AS (SELECT recording_id, input_id, max(decision) FILTER (WHERE arm = 'A') AS a, max(decision) FILTER (WHERE arm = 'A_prime') AS p, max(decision) FILTER (WHERE arm = 'B') AS b FROM maj GROUP BY ALL)
SELECT recording_id, coalesce(fired, false) AS fired, count(*) AS n, count(*) FILTER (WHERE a <> p) AS flips_decoy, count(*) FILTER (WHERE a <> b) AS flips_target FROM p LEFT JOIN fired USING (recording_id, input_id)
WHERE a IS NOT NULL AND p IS NOT NULL AND b IS NOT NULL GROUP BY ALL""")
def a12_flips(spark, d):
    return diagnosis.flips(diagnosis.majorities(_decided(spark, d), ["recording_id", "input_id"]), log.touched(table(spark, d, "activation")), BY)


@query(f"WITH {MODED}, c AS (SELECT recording_id, input_id, arm, count(DISTINCT mode) / count(*) AS f FROM moded GROUP BY ALL) SELECT recording_id, arm, round(avg(f), 9) AS fraction FROM c GROUP BY ALL")
def a15_distinct_fraction(spark, d):
    return diagnosis.distinct_fraction(_moded(spark, d), BY)


@query(rf"""WITH {LAST} SELECT recording_id, arm, count(*) AS n, count(*) FILTER (WHERE regexp_replace(output, '^\s+|\s+$', '', 'g') <> '') AS nonempty,
count(*) FILTER (WHERE coalesce(json_type(CASE WHEN json_valid(nullif(regexp_extract(output, '(?s)(\{{.*\}})', 1), '')) THEN regexp_extract(output, '(?s)(\{{.*\}})', 1) END) = 'OBJECT', false)) AS json_inside,
count(*) FILTER (WHERE regexp_matches(output, '^\s*(APPROVE|DECLINE|ESCALATE)\b')) AS decision_first, count(*) FILTER (WHERE regexp_matches(output, '\b(APPROVE|DECLINE|ESCALATE)\b')) AS decision_anywhere,
count(*) FILTER (WHERE length(output) - length(replace(output, '.', '')) >= 3) AS three_stops FROM usable GROUP BY ALL""")
def a18_x20_output_profile(spark, d):
    return diagnosis.output_profile(log.usable(log.replayed(samples(spark, d))), ["recording_id", "arm"])


#: Every kind of rule in SQL; families of writing are told by their letters, of which the log has Latin ones.
CONTRACT = rf"""seen AS (SELECT recording_id, input_id, min(line_no) AS seen FROM usable GROUP BY ALL),
pool AS (SELECT u.recording_id, arm, output, ROW(seen, sample_idx, line_no) AS pos, regexp_replace(output, '\s+$', '') AS tail, {words_sql('output')} AS words, json_valid(output) AS jv, coalesce(json_type(CASE WHEN json_valid(output) THEN output END) = 'OBJECT', false) AS jo,
  CASE WHEN output = '' THEN 0 ELSE len(string_split(output, chr(10))) - CASE WHEN output LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS lines FROM usable u JOIN seen USING (recording_id, input_id) WHERE arm IN ('A', 'A_prime', 'B')),
rng AS (SELECT recording_id, min(words) AS w0, max(words) AS w1, min(lines) AS l0, max(lines) AS l1, bool_or(regexp_matches(output, '\p{{Latin}}')) AS latin, count(DISTINCT output) FILTER (WHERE jo) AS objects FROM pool WHERE arm = 'A' GROUP BY 1),
obj AS (SELECT DISTINCT recording_id, output FROM pool WHERE arm = 'A' AND jo),
kv AS (SELECT recording_id, output, key, json_extract(output, '$."' || key || '"') AS v FROM (SELECT recording_id, output, unnest(json_keys(output)) AS key FROM obj)),
kt AS (SELECT recording_id, key, CASE json_type(v) WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'int' END AS type,
  CASE json_type(v) WHEN 'BOOLEAN' THEN CASE WHEN CAST(v AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END WHEN 'NULL' THEN 'None' ELSE json_extract_string(v, '$') END AS value FROM kv),
ks AS (SELECT recording_id, key, count(*) AS n, count(DISTINCT type) AS types, min(type) AS type, count(DISTINCT value) AS vals, list_sort(list(DISTINCT value)) AS allowed FROM kt GROUP BY ALL),
fit AS (SELECT ks.* FROM ks JOIN rng USING (recording_id) WHERE n = objects),
rules AS (SELECT recording_id, kind, NULL::VARCHAR AS key, NULL::BIGINT AS lo, NULL::BIGINT AS hi, NULL::VARCHAR[] AS allowed FROM rng, (VALUES ('nonempty'), ('no_control_chars'), ('no_unicode_escape'), ('no_refusal_marker'), ('ends_with_terminator')) k(kind)
  UNION ALL SELECT recording_id, 'word_count_range', NULL, w0, w1, NULL FROM rng UNION ALL SELECT recording_id, 'line_count_range', NULL, l0, l1, NULL FROM rng UNION ALL SELECT recording_id, 'script_subset', NULL, NULL, NULL, ['LATIN'] FROM rng WHERE latin
  UNION ALL SELECT recording_id, 'parses_json', NULL, NULL, NULL, NULL FROM rng WHERE objects > 0 UNION ALL SELECT recording_id, 'json_key_present', key, NULL, NULL, NULL FROM fit
  UNION ALL SELECT recording_id, 'json_key_type', key, NULL, NULL, [type] FROM fit WHERE types = 1 UNION ALL SELECT recording_id, 'json_enum', key, NULL, NULL, allowed FROM fit WHERE vals > 1 AND vals <= 6),
pk AS (SELECT p.recording_id, p.arm, p.output, p.pos, r.kind, r.key, r.lo, r.hi, r.allowed, words, lines, tail, jv, jo, CASE WHEN jo AND r.key IS NOT NULL THEN json_extract(output, '$."' || r.key || '"') END AS v FROM pool p JOIN rules r USING (recording_id)),
held AS (SELECT recording_id, arm, output, pos, kind, key, lo, hi, allowed, coalesce(CASE kind WHEN 'nonempty' THEN regexp_replace(output, '^\s+|\s+$', '', 'g') <> '' WHEN 'no_control_chars' THEN NOT regexp_matches(output, {literal(X.CONTROL)})
  WHEN 'no_unicode_escape' THEN NOT regexp_matches(output, {literal(X.ESCAPE)}) WHEN 'no_refusal_marker' THEN NOT regexp_matches(output, {literal('(?i)' + X.REFUSAL)}) WHEN 'ends_with_terminator' THEN tail <> '' AND regexp_matches(tail, {literal(X.TERMINATOR)})
  WHEN 'word_count_range' THEN words BETWEEN lo AND hi WHEN 'line_count_range' THEN lines BETWEEN lo AND hi WHEN 'script_subset' THEN NOT regexp_matches(output, '[\p{{Greek}}\p{{Cyrillic}}\p{{Thai}}\p{{Hangul}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Arabic}}\p{{Hebrew}}\p{{Devanagari}}]')
  WHEN 'parses_json' THEN jv WHEN 'json_key_present' THEN v IS NOT NULL
  WHEN 'json_key_type' THEN list_contains(allowed, CASE json_type(v) WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE CASE WHEN v IS NOT NULL THEN 'int' END END)
  WHEN 'json_enum' THEN list_contains(allowed, CASE json_type(v) WHEN 'BOOLEAN' THEN CASE WHEN CAST(v AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END WHEN 'NULL' THEN 'None' ELSE json_extract_string(v, '$') END) END, false) AS ok FROM pk),
sup AS (SELECT recording_id, kind, key, lo, hi, allowed, coalesce(avg(CAST(ok AS INT)) FILTER (WHERE arm = 'A'), 0) AS s_base, coalesce(avg(CAST(ok AS INT)) FILTER (WHERE arm = 'A_prime'), 0) AS s_decoy FROM held WHERE arm <> 'B' GROUP BY ALL)"""
TIER = "CASE WHEN least(s_base, s_decoy) >= 0.99 THEN 'hard' WHEN least(s_base, s_decoy) >= 0.6 THEN 'band' ELSE 'discarded' END"


@query(f"WITH {LAST}, {CONTRACT} SELECT recording_id, kind, key, lo, hi, array_to_string(allowed, '|') AS allowed, round(s_base, 9) AS s_base, round(s_decoy, 9) AS s_decoy, {TIER} AS tier, s_base >= 0.99 AND s_decoy < 0.99 AS pruned FROM sup")
def r1_r3_contract(spark, d):
    c, _ = plan.rules(samples(spark, d))
    return c.select("recording_id", "kind", "key", "lo", "hi", F.array_join("allowed", "|").alias("allowed"), F.round("s_base", 9).alias("s_base"), F.round("s_decoy", 9).alias("s_decoy"), "tier", "pruned")


@query(f"WITH {LAST}, {CONTRACT} SELECT recording_id, kind, count(*) AS n_rules, round(min(s_base), 9) AS s_base, round(min(s_decoy), 9) AS s_decoy, count(*) FILTER (WHERE {TIER} = 'hard') AS n_hard, count(*) FILTER (WHERE s_base >= 0.99 AND s_decoy < 0.99) AS n_pruned FROM sup GROUP BY ALL")
def r2_r3_supports(spark, d):
    """The least support of each kind of rule, and how many rules of it hold."""
    c, _ = plan.rules(samples(spark, d))
    return c.groupBy("recording_id", "kind").agg(F.count(F.lit(1)).alias("n_rules"), F.round(F.min("s_base"), 9).alias("s_base"), F.round(F.min("s_decoy"), 9).alias("s_decoy"), F.count_if(F.col("tier") == "hard").alias("n_hard"), F.count_if("pruned").alias("n_pruned"))


BROKEN = f"""b AS (SELECT h.* FROM held h JOIN sup s ON h.recording_id = s.recording_id AND h.kind = s.kind AND h.key IS NOT DISTINCT FROM s.key WHERE arm = 'B' AND {TIER} = 'hard'),
n AS (SELECT recording_id, kind, key, count(*) AS n_total, count(*) FILTER (WHERE NOT ok) AS n_violating FROM b GROUP BY ALL),
ex AS (SELECT recording_id, kind, key, output, min(pos) AS pos FROM b WHERE NOT ok GROUP BY ALL),
e3 AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY recording_id, kind, key ORDER BY pos, output) <= 3),
eg AS (SELECT recording_id, kind, key, string_agg(substr(output, 1, 160), ' | ' ORDER BY pos, output) AS examples FROM e3 GROUP BY ALL)"""


@query(f"WITH {LAST}, {CONTRACT}, {BROKEN} SELECT recording_id, kind, count(*) AS n_rules, max(n_violating) AS n_violating, round(max(n_violating / n_total), 9) AS rate FROM n WHERE n_violating > 0 GROUP BY ALL")
def r4_violations(spark, d):
    """How many rules of each kind the candidate breaks, and how often the most broken one."""
    _, v = plan.rules(samples(spark, d))
    return v.groupBy("recording_id", "kind").agg(F.count(F.lit(1)).alias("n_rules"), F.max("n_violating").alias("n_violating"), F.round(F.max("rate"), 9).alias("rate"))


@query(f"""WITH {LAST}, {CONTRACT}, {BROKEN} SELECT n.recording_id, n.kind, n.key, n_total, n_violating, round(n_violating / n_total, 9) AS rate, examples, list_position({KINDS!r}, n.kind) AS rule_ord
FROM n JOIN eg ON n.recording_id = eg.recording_id AND n.kind = eg.kind AND n.key IS NOT DISTINCT FROM eg.key WHERE n_violating > 0""")
def d9_r4_all_violations(spark, d):
    _, v = plan.rules(samples(spark, d))
    return v.select("recording_id", "kind", "key", "n_total", "n_violating", F.round("rate", 9).alias("rate"), F.array_join("examples", " | ").alias("examples"), F.col("rule_ord").cast("int").alias("rule_ord"))


@query()
def u3_u5_lexical_clusters(spark, d):
    """Greedy clustering with a stand-in predicate: same first word and at least half of the words in common."""

    def same(pairs):
        out = []
        for a, b in pairs:
            x, y = a.lower().split(), b.lower().split()
            out.append(x[:1] == y[:1] and len(set(x) & set(y)) * 2 >= len(set(x) | set(y)))
        return out

    m = _moded(spark, d).where("arm in ('A', 'B')")
    c = modes.greedy_clusters(m, ["recording_id", "input_id"], same)
    return c.groupBy("recording_id", "input_id").agg(F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("distinct_modes"), F.max("calls").alias("calls"))


@query()
def q4_q15_reports(spark, d):
    flagged, sel, best = plan.judged(_scored(spark, d), BY, 0.10)
    return plan.report(flagged, sel, best, BY, 0.10)


@query(f"""WITH {LAST}, o AS (SELECT recording_id, input_id, arm, output, row_number() OVER (PARTITION BY recording_id, input_id, arm ORDER BY sample_idx, ord, line_no) AS place FROM usable)
SELECT a.recording_id, a.input_id, round(avg(abs(length(a.output) - length(b.output))) FILTER (WHERE b.arm = 'B'), 9) AS target, round(avg(abs(length(a.output) - length(b.output))) FILTER (WHERE b.arm = 'A_prime'), 9) AS decoy
FROM o a JOIN o b ON a.recording_id = b.recording_id AND a.input_id = b.input_id AND a.place = b.place AND a.arm = 'A' AND b.arm IN ('B', 'A_prime') GROUP BY ALL""")
def u7_positional_scores(spark, d):
    """A channel that scores outputs at equal places; the difference of lengths stands in for a model's score."""
    kept = log.usable(log.replayed(samples(spark, d))).where("arm in ('A', 'A_prime', 'B')")
    p = modes.positional_pairs(kept, ["recording_id", "input_id"]).withColumn("score", F.abs(F.length("a") - F.length("b")))
    mean = lambda side: F.round(F.avg(F.when(F.col("side") == side, F.col("score"))), 9)
    return p.groupBy("recording_id", "input_id").agg(mean("t").alias("target"), mean("d").alias("decoy"))


@query(ALL.rstrip() + """, f AS (SELECT recording_id, channel, count(*) FILTER (WHERE flagged) AS n_flagged, count(*) AS n_inputs FROM flags GROUP BY ALL)
SELECT recording_id, channel, n_inputs, n_flagged, round(n_flagged / n_inputs, 9) AS share FROM f""")
def q9_q11_channel_rows(spark, d):
    """One row per recording and channel, as the study's matrix has them."""
    f = plan.judged(_scored(spark, d), BY, 0.10)[0]
    return _rounded(f.groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if(F.col("flagged")).alias("n_flagged")).withColumn("share", F.col("n_flagged") / F.col("n_inputs")), "share")
