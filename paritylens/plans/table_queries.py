"""Queries of text functions, probes, tools, faults, generators and campaign tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.functions import text as X
from paritylens.operators import dedup, diagnosis, faults, generators, grading, judging, probes, tools
from paritylens.plans.detect import corpus_digest, corpus_fingerprint
from paritylens.plans.log_queries import samples
from paritylens.plans.registry import literal, query, shape_sql, strip_sql, table, text_sql, words_sql

# -- text ---------------------------------------------------------------------


@query(f"SELECT recording_id, line_no, {text_sql('output')} AS plain FROM samples")
def x1_normalised_text(spark, d):
    return samples(spark, d).select("recording_id", "line_no", X.normalise_text(F.col("output")).alias("plain"))


@query()
def x2_x3_normalised(spark, d):
    return samples(spark, d).select("recording_id", "line_no", X.normalise(F.col("output")).alias("mode"))


@query(rf"WITH t AS (SELECT recording_id, line_no, {text_sql('output')} AS t FROM samples) SELECT recording_id, line_no, array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), '¦') AS sentences FROM t")
def x4_sentences(spark, d):
    return samples(spark, d).select("recording_id", "line_no", F.array_join(X.sentences(F.col("output")), "¦").alias("sentences"))


@query(f"SELECT doc_id, json_valid({strip_sql('text')}) AS is_json FROM documents")
def x5_is_json(spark, d):
    return table(spark, d, "documents").select("doc_id", X.json_facts(X.strip(F.col("text")))["valid"].alias("is_json"))


@query(f"SELECT doc_id, {shape_sql('text')} AS shape FROM documents")
def x6_shapes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.shape(F.col("text")).alias("shape"))


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(lower({text_sql('text')}), '[\p{{L}}\p{{N}}_]+'), ' ') AS words FROM documents")
def x7_word_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.word_tokens(F.col("text")), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-zÀ-ÿ]') THEN 'LATIN' ELSE '' END AS scripts FROM documents")
def x8_scripts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.scripts(F.col("text")), ",").alias("scripts"))


_TAIL = r"regexp_replace(output, '\s+$', '')"


@query(f"""SELECT recording_id, line_no, regexp_matches(output, {literal('(?i)' + X.REFUSAL)}) AS refuses, regexp_matches(output, {literal(X.ESCAPE)}) AS has_escape, regexp_matches(output, {literal(X.CONTROL)}) AS has_control,
{_TAIL} <> '' AND regexp_matches({_TAIL}, {literal(X.TERMINATOR)}) AS terminated FROM samples""")
def x9_x10_markers(spark, d):
    o = F.col("output")
    return samples(spark, d).select("recording_id", "line_no", X.refuses(o).alias("refuses"), X.has_escape(o).alias("has_escape"), X.has_control(o).alias("has_control"), X.terminated(o).alias("terminated"))


@query(rf"SELECT doc_id, {words_sql('text')} AS words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS lines FROM documents")
def x11_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"), X.line_count(F.col("text")).cast("long").alias("lines"))


@query("SELECT recording_id, line_no, json_valid(trim(output)) AND json_type(CASE WHEN json_valid(trim(output)) THEN output END) = 'OBJECT' AS is_object, CASE WHEN json_valid(trim(output)) THEN json_extract_string(output, '$.decision') END AS decision FROM samples")
def x12_json_keys(spark, d):
    f = X.json_facts(F.trim(F.col("output")))
    s = samples(spark, d).select("recording_id", "line_no", f.alias("f"))
    at = F.array_position(F.coalesce("f.keys", F.array().cast("array<string>")), F.lit("decision")).cast("int")
    return s.select("recording_id", "line_no", F.col("f.object").alias("is_object"), F.when(at > 0, F.try_element_at("f.values", at)).alias("decision"))


@query("""WITH o AS (SELECT recording_id, line_no, output FROM samples WHERE json_valid(output) AND json_type(CASE WHEN json_valid(output) THEN output END) = 'OBJECT'),
k AS (SELECT recording_id, line_no, key, json_type(json_extract(output, '$."' || key || '"')) AS t FROM (SELECT *, unnest(json_keys(output)) AS key FROM o))
SELECT recording_id, line_no, string_agg(key || ':' || CASE t WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' WHEN 'NULL' THEN 'NoneType' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'int' END, ',' ORDER BY key) AS types FROM k GROUP BY ALL""")
def x12_json_types(spark, d):
    """Names and types of the fields of every output that is an object."""
    s = samples(spark, d).select("recording_id", "line_no", X.json_facts(F.col("output")).alias("f")).where("f.object")
    pairs = F.transform(F.arrays_zip("f.keys", "f.types"), lambda x: F.concat_ws(":", x["keys"], x["types"]))
    return s.where(F.size("f.keys") > 0).select("recording_id", "line_no", F.array_join(F.array_sort(pairs), ",").alias("types"))


@query(r"SELECT recording_id, line_no, CASE WHEN contains(x, '</think>') THEN regexp_replace(regexp_replace(x, '(?s)^.*</think>', ''), '^\s+', '') ELSE x END AS answer FROM (SELECT *, CASE WHEN sample_idx % 3 = 0 THEN 'hm </think> ' || output ELSE output END AS x FROM samples)")
def x14_without_thinking(spark, d):
    x = F.when(F.col("sample_idx") % 3 == 0, F.concat(F.lit("hm </think> "), "output")).otherwise(F.col("output"))
    return samples(spark, d).select("recording_id", "line_no", X.without_thinking(x).alias("answer"))


@query("SELECT DISTINCT input_id, CAST('0x' || substr(sha256('7|' || input_id), 1, 15) AS BIGINT) AS h FROM samples")
def x15_stable_hash(spark, d):
    h = X.stable_hash(F.lit("7"), F.col("input_id"))
    return samples(spark, d).select("input_id", F.floor(h / F.lit(16)).cast("long").alias("h")).distinct()


@query("SELECT substr(sha256(string_agg(CAST(msg_id AS VARCHAR) || coalesce(chr(0) || text, '') || chr(10), '' ORDER BY CAST(msg_id AS VARCHAR))), 1, 16) AS fingerprint FROM messages")
def x16_fingerprint(spark, d):
    return corpus_fingerprint(table(spark, d, "messages").select(F.col("msg_id").cast("string").alias("input_id"), "text"))


@query("""WITH h AS (SELECT sha256(CAST(msg_id AS VARCHAR) || coalesce(chr(0) || text, '') || chr(10)) AS h FROM messages), r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
SELECT substr(sha256(string_agg(d, '' ORDER BY r)), 1, 16) AS fingerprint FROM r""")
def x16_corpus_digest(spark, d):
    return corpus_digest(table(spark, d, "messages").select(F.col("msg_id").cast("string").alias("input_id"), "text"), 3)


@query("SELECT DISTINCT input_id, array_to_string(list_slice(string_split(input_id, '-'), -2, -1), '-') AS short FROM samples")
def x19_short_ids(spark, d):
    return samples(spark, d).select("input_id", X.short_id(F.col("input_id")).alias("short")).distinct()


@query("SELECT recording_id, line_no, regexp_matches(output, '(?i)sable|osprey') AS names FROM samples")
def x21_names_a_model(spark, d):
    return samples(spark, d).select("recording_id", "line_no", X.names_model(F.col("output"), ["sable", "osprey"]).alias("names"))


@query("SELECT msg_id, coalesce(lower(lang), 'xx') || '-' || coalesce(theme, 'none') || '-' || direction || '-' || printf('%03d', msg_id) AS tag FROM messages")
def x22_tags(spark, d):
    return table(spark, d, "messages").select("msg_id", F.concat_ws("-", F.coalesce(F.lower("lang"), F.lit("xx")), F.coalesce("theme", F.lit("none")), "direction", F.format_string("%03d", "msg_id")).alias("tag"))


DEDUP = r"""k AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS input_id, regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS key FROM documents)"""


@query(f"WITH {DEDUP} SELECT input_id, arg_min(input_id, pos) OVER (PARTITION BY key) AS kept_id, count(*) OVER (PARTITION BY key) AS n FROM k")
def d1_d2_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("input_id"), "text")
    return dedup.groups(docs).select("input_id", "kept_id", "n")


@query(f"WITH {DEDUP} SELECT count(*) AS n_inputs, count(DISTINCT key) AS n_kept, round((count(*) - count(DISTINCT key)) / count(*), 9) AS rate FROM k")
def d1_duplication_rate(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("input_id"), "text")
    return dedup.duplication_rate(dedup.groups(docs)).withColumn("rate", F.round("rate", 9))


@query("WITH p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id FROM p WHERE x = y")
def d10_degenerate_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(nxt, "doc_id").where("text = other").select("doc_id")


@query(rf"""SELECT doc_id, {words_sql('text')} AS words, round(coalesce((length(text) - length(replace(text, '—', ''))) * 1000e0 / nullif({words_sql('text')}, 0), 0), 6) AS dashes_per_1000,
len(regexp_extract_all(text, '\*\*[^*\n]+\*\*')) AS bold_spans, len(regexp_extract_all(text, '\b[A-Z]{{2,4}}-[0-9]{{3,}}\b')) AS ids FROM documents""")
def a31_prose_metrics(spark, d):
    m = diagnosis.prose_metrics(table(spark, d, "documents"), "text", ["doc_id"])
    return m.select("doc_id", *(F.col(c).cast("long").alias(c) if c != "dashes_per_1000" else F.col(c) for c in ("words", "dashes_per_1000", "bold_spans", "ids")))


# -- statistics of probes -------------------------------------------------------

PROBES = """pr AS (SELECT a.vec_id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score,
  CASE a.label % 3 WHEN 0 THEN 'PRESERVING' WHEN 1 THEN 'BREAKING' ELSE 'REGISTER' END AS relation, 'c' || a.label AS category, CASE WHEN a.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS shape FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _probes(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    dot = F.aggregate(F.zip_with("embedding", "other", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    relation = F.element_at(F.array(F.lit("PRESERVING"), F.lit("BREAKING"), F.lit("REGISTER")), (F.col("label") % 3 + 1).cast("int"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(1 - dot, 6).alias("score"), relation.alias("relation"), F.concat(F.lit("c"), "label").alias("category"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("shape"))


@query(f"WITH {PROBES} SELECT vec_id, score, relation, category, shape FROM pr")
def u8_embedding_pairs(spark, d):
    return _probes(spark, d)


@query(f"WITH {PROBES} SELECT category, count(*) AS n, min(score) AS min, round(median(score), 9) AS median, max(score) AS max FROM pr GROUP BY 1")
def a13_describe(spark, d):
    return probes.describe(_probes(spark, d), ["category"], "score").withColumn("median", F.round("median", 9))


@query(f"WITH {PROBES}, r AS (SELECT category, score, row_number() OVER (PARTITION BY category ORDER BY score) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM pr) SELECT category, score AS upper_median FROM r WHERE place = n // 2")
def a14_upper_median(spark, d):
    return probes.upper_median(_probes(spark, d), ["category"], "score")


@query(f"WITH {PROBES} SELECT shape AS level, round(quantile_cont(score, 0.95), 9) AS threshold FROM pr WHERE relation = 'PRESERVING' GROUP BY 1")
def a19_thresholds(spark, d):
    return probes.thresholds(_probes(spark, d), 0.05, True).withColumn("threshold", F.round("threshold", 9))


WILSON = "round(CASE WHEN n > 0 THEN greatest(0e0, (k / n + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) - 1.96e0 * sqrt(k / n * (1 - k / n) / n + 3.8416e0 / (4 * n * n)) / (1 + 3.8416e0 / n)) END, 9) AS lo, round(CASE WHEN n > 0 THEN least(1e0, (k / n + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) + 1.96e0 * sqrt(k / n * (1 - k / n) / n + 3.8416e0 / (4 * n * n)) / (1 + 3.8416e0 / n)) END, 9) AS hi"


@query(f"WITH c AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id % 3 = 0) AS k FROM embeddings GROUP BY 1) SELECT label, {WILSON} FROM c")
def a20_wilson(spark, d):
    c = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("vec_id % 3 = 0")).alias("k"))
    lo, hi = probes.wilson(F.col("k"), F.col("n"))
    return c.select("label", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query(f"""WITH {PROBES}, r AS (SELECT shape, relation = 'BREAKING' AS pos, rank() OVER (PARTITION BY shape ORDER BY score) + (count(*) OVER (PARTITION BY shape, score) - 1) / 2 AS r FROM pr)
SELECT shape, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 9) AS auc FROM r GROUP BY 1""")
def a21_w5_auc(spark, d):
    return probes.auc(_probes(spark, d).withColumn("positive", F.col("relation") == "BREAKING"), ["shape"]).withColumn("auc", F.round("auc", 9))


EVALUATE = f"""th AS (SELECT quantile_cont(score, 0.95) AS threshold FROM pr WHERE relation = 'PRESERVING'),
nm AS (SELECT pr.*, CASE relation WHEN 'BREAKING' THEN category WHEN 'REGISTER' THEN '[reg] ' || category ELSE '[fp] ' || category END AS name, threshold FROM pr, th),
au AS (SELECT a.name, sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM nm a, nm b WHERE a.relation <> 'PRESERVING' AND b.relation = 'PRESERVING' GROUP BY 1),
ag AS (SELECT name, count(*) AS n, count(*) FILTER (WHERE score > threshold) AS k, median(score) AS median_score, any_value(threshold) AS threshold FROM nm GROUP BY 1)"""


@query(f"WITH {PROBES}, {EVALUATE} SELECT '__global__' AS level, name AS category, n, k AS detected, round(k / n, 9) AS rate, {WILSON}, round(auc, 9) AS auc, round(median_score, 9) AS median_score, round(threshold, 9) AS threshold FROM ag LEFT JOIN au USING (name)")
def a22_evaluate(spark, d):
    e = probes.evaluate(_probes(spark, d))
    return e.select(*(F.round(c, 9).alias(c) if c in ("rate", "lo", "hi", "auc", "median_score", "threshold") else F.col(c) for c in e.columns))


@query(f"""WITH {PROBES}, th AS (SELECT shape, quantile_cont(score, 0.95) AS threshold FROM pr WHERE relation = 'PRESERVING' GROUP BY 1),
nm AS (SELECT pr.*, CASE relation WHEN 'BREAKING' THEN category WHEN 'REGISTER' THEN '[reg] ' || category ELSE '[fp] ' || category END AS name, threshold FROM pr JOIN th USING (shape))
SELECT shape AS level, name AS category, count(*) AS n, count(*) FILTER (WHERE score > threshold) AS detected, round(count(*) FILTER (WHERE score > threshold) / count(*), 9) AS rate FROM nm GROUP BY ALL""")
def a22_evaluate_per_shape(spark, d):
    return probes.evaluate(_probes(spark, d), per_shape=True).select("level", "category", "n", "detected", F.round("rate", 9).alias("rate"))


@query(f"WITH {PROBES} SELECT count(*) FILTER (WHERE relation = 'BREAKING') AS n_pos, count(*) FILTER (WHERE relation = 'PRESERVING') AS n_neg, round((SELECT avg(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) FROM pr a, pr b WHERE a.relation = 'BREAKING' AND b.relation = 'PRESERVING'), 9) AS auc FROM pr")
def a23_separability(spark, d):
    return probes.separability(_probes(spark, d)).withColumn("auc", F.round("auc", 9))


GRID = """g AS (SELECT i / 20e0 AS threshold, count(*) FILTER (WHERE same AND least(f, b) >= i / 20e0) / nullif(count(*) FILTER (WHERE same), 0) AS tpr, count(*) FILTER (WHERE NOT same AND least(f, b) >= i / 20e0) / nullif(count(*) FILTER (WHERE NOT same), 0) AS fpr
FROM (SELECT label % 2 = 0 AS same, (vec_id * 37 % 101) / 101e0 AS f, (vec_id * 53 % 103) / 103e0 AS b FROM embeddings), range(1, 20) r(i) GROUP BY i)"""


def _grid(spark, d):
    x = table(spark, d, "embeddings").select((F.col("label") % 2 == 0).alias("same"), (F.col("vec_id") * 37 % 101 / F.lit(101.0)).alias("forward"), (F.col("vec_id") * 53 % 103 / F.lit(103.0)).alias("backward"))
    return probes.balanced_accuracy(x)


@query(f"WITH {GRID} SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round((tpr + 1 - fpr) / 2, 9) AS balanced FROM g")
def a24_accuracy_grid(spark, d):
    return _grid(spark, d).select("threshold", *(F.round(c, 9).alias(c) for c in ("tpr", "fpr", "balanced")))


@query(f"WITH {GRID} SELECT threshold, round((tpr + 1 - fpr) / 2, 9) AS balanced FROM g ORDER BY (tpr + 1 - fpr) / 2 DESC, threshold LIMIT 1")
def a24_best_threshold(spark, d):
    return probes.best_threshold(_grid(spark, d)).select("threshold", F.round("balanced", 9).alias("balanced"))


@query(f"""WITH {PROBES}, t AS (SELECT shape AS channel, quantile_cont(score, 0.95) AS t FROM pr WHERE relation = 'PRESERVING' GROUP BY 1),
h AS (SELECT shape AS channel, category, avg(CASE WHEN score > t THEN 1e0 ELSE 0e0 END) AS r FROM pr JOIN t ON pr.shape = t.channel GROUP BY ALL)
SELECT channel, round(max(r) FILTER (WHERE category = 'c1'), 9) AS c1, round(max(r) FILTER (WHERE category = 'c4'), 9) AS c4, round(max(r) FILTER (WHERE category = 'c99'), 9) AS c99 FROM h GROUP BY 1""")
def a25_blind_spots(spark, d):
    return probes.blind_spots(_probes(spark, d).withColumn("channel", F.col("shape")), ["c1", "c4", "c99"]).withColumn("c99", F.col("c99").cast("double"))


@query("""WITH r AS (SELECT label % 3 AS fault, label AS severity, avg(CASE WHEN vec_id % 7 < label % 5 THEN 1e0 ELSE 0e0 END) AS recall FROM embeddings GROUP BY ALL)
SELECT fault, severity, round(recall, 9) AS recall, coalesce(recall < lag(recall) OVER (PARTITION BY fault ORDER BY severity) - 0.05e0, false) AS falls FROM r""")
def a29_w7_titration(spark, d):
    r = table(spark, d, "embeddings").groupBy((F.col("label") % 3).alias("fault"), F.col("label").alias("severity")).agg(F.avg((F.col("vec_id") % 7 < F.col("label") % 5).cast("double")).alias("recall"))
    return grading.titration(r).withColumn("recall", F.round("recall", 9))


@query("""SELECT lower(trim(status)) AS model, count(*) AS n, count(*) FILTER (WHERE qty % 3 = unit_price_eur::BIGINT % 3) AS hits, round(avg(CASE WHEN qty % 3 = unit_price_eur::BIGINT % 3 THEN 1e0 ELSE 0e0 END), 9) AS share, count(*) FILTER (WHERE qty > 5) AS chains_ok, max(qty) AS schema_tokens FROM campaign_orders GROUP BY 1""")
def a32_tool_scores(spark, d):
    o = table(spark, d, "campaign_orders").select(F.lower(F.trim("status")).alias("model"), (F.col("qty") % 3).cast("long").alias("wanted"), (F.round("unit_price_eur", 0).cast("long") % 3).alias("called"), (F.col("qty") > 5).alias("chain_ok"), F.col("qty").alias("schema_tokens"))
    return diagnosis.tool_scores(o)


@query("SELECT client_id, coalesce(nullif(lower(trim(status)), ''), 'blank') AS verdict, count(*) AS n FROM campaign_orders WHERE client_id IS NOT NULL GROUP BY ALL")
def a26_w8_verdicts(spark, d):
    """A queue written out of the orders, one per client, and read back line by line."""
    w = Window.partitionBy("client_id").orderBy("order_id", "loaded_at")
    o = table(spark, d, "campaign_orders").where("client_id is not null").withColumn("n", F.row_number().over(w))
    two = F.array(F.concat(F.lit("## Cas "), F.col("n"), F.lit(" (id: "), F.col("order_id"), F.lit(")")), F.concat(F.lit("verdict: "), F.coalesce("status", F.lit(""))))
    lines = o.select("client_id", "n", F.posexplode(two).alias("p", "line")).select("client_id", (F.col("n") * 2 + F.col("p")).alias("line_no"), "line")
    return judging.tally(judging.verdicts(lines, ["client_id"]), ["client_id"])


# -- the tool layer --------------------------------------------------------------


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus AS status, CASE WHEN o.o_orderkey IS NULL THEN 'no such entity: ' || l.l_orderkey END AS error FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) o ON o.o_orderkey = l.l_orderkey")
def j6_lookup(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return tools.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey").select("l_orderkey", "l_linenumber", "status", "error")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 50000e0 END AS low, CASE WHEN c_custkey % 4 <> 0 THEN 150000e0 END AS high FROM customer)
SELECT k, low, high, count(o_orderkey) FILTER (WHERE (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice <= high)) AS n, round(coalesce(sum(o_totalprice) FILTER (WHERE (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice <= high)), 0), 2) AS total FROM c LEFT JOIN orders ON o_custkey = k GROUP BY ALL""")
def j7_search(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.lit(50000.0)).alias("low"), F.when(F.col("c_custkey") % 4 != 0, F.lit(150000.0)).alias("high"))
    return tools.search(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("amount")), "k")


@query("""WITH p AS (SELECT * FROM (VALUES (0, 'late'), (1, 'discount request'), (2, 'late payment'), (3, 'incomplete')) v(ordinal, name)), t AS (SELECT msg_id, replace(theme, '_', ' ') AS topic FROM messages)
SELECT msg_id, topic, (SELECT arg_min(name, ordinal) FROM p WHERE contains(name, lower(topic)) OR contains(lower(topic), name)) AS policy FROM t""")
def j8_policy(spark, d):
    p = spark.createDataFrame([(0, "late"), (1, "discount request"), (2, "late payment"), (3, "incomplete")], "ordinal int, name string")
    return tools.policy(table(spark, d, "messages").select("msg_id", F.replace("theme", F.lit("_"), F.lit(" ")).alias("topic")), p)


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice / (o_custkey % 7) END, 4) AS ratio, CASE WHEN o_custkey % 7 = 0 THEN 'denominator is zero' END AS error FROM orders")
def j9_compute(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tools.compute(F.col("o_totalprice"), F.col("o_custkey") % 7).alias("r")).select("o_orderkey", "r.*")


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal AS annual_income, CAST(c_custkey % 900 AS DOUBLE) AS existing_debt, c_nationkey AS years_on_record FROM customer), q AS (SELECT *, round(existing_debt / CASE WHEN coalesce(annual_income, 0) = 0 THEN 1 ELSE annual_income END, 4) AS ratio FROM p)
SELECT id, ratio, years_on_record >= 8 AND ratio <= 0.4e0 AS meets_criteria FROM q""")
def j10_evaluate(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("annual_income"), (F.col("c_custkey") % 900).cast("double").alias("existing_debt"), F.col("c_nationkey").alias("years_on_record"))
    return tools.evaluate(p, 8, 0.4).select("id", "ratio", "meets_criteria")


@query("SELECT c_custkey, c_acctbal, count(o_orderkey) AS n_owned, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def j11_history(spark, d):
    return tools.history(table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount")), "c_custkey")


@query("SELECT order_id, loaded_at, p.product_id IS NOT NULL AND o.qty > 3 AS done, substr(p.designation, 1, 120) AS reason FROM campaign_orders o LEFT JOIN products p USING (product_id)")
def j12_verify_act(spark, d):
    p = table(spark, d, "products").select(F.col("product_id").alias("id"), F.col("designation").alias("reason"), F.lit(True).alias("valid"))
    return tools.act(table(spark, d, "campaign_orders").select("order_id", "loaded_at", "qty", "product_id"), p, "product_id").select("order_id", "loaded_at", (F.coalesce("valid", F.lit(False)) & (F.col("qty") > 3)).alias("done"), "reason")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id END, CASE WHEN doc_id % 2 = 0 THEN 'y' || doc_id END) AS entity FROM documents")
def j13_arguments(spark, d):
    docs = table(spark, d, "documents")
    args = F.map_from_entries(F.filter(F.array(F.struct(F.when(F.col("doc_id") % 3 == 0, "entityid").alias("k"), F.concat(F.lit("x"), "doc_id").alias("v")), F.struct(F.when(F.col("doc_id") % 2 == 0, "id").alias("k"), F.concat(F.lit("y"), "doc_id").alias("v"))), lambda x: x["k"].isNotNull()))
    return docs.select("doc_id", tools.argument(args, "entity_id").alias("entity"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice AS a, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_totalprice) AS b FROM orders)
SELECT o_custkey AS input_id, 0 AS sample_idx, bool_or(a IS DISTINCT FROM b) AS activated FROM s GROUP BY 1""")
def j14_w3_g7_stale_calls(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("input_id"), F.lit(0).alias("sample_idx"), "o_orderkey", "o_totalprice")
    return tools.changed_calls(o, tools.stale_view(o, ["input_id"], "o_orderkey", "o_totalprice"), ["input_id", "sample_idx", "o_orderkey"], "o_totalprice")


@query("SELECT user_id AS input_id, bool_or(event_type IN ('error', 'purchase')) AS activated FROM events GROUP BY 1")
def j15_withdrawn_tools(spark, d):
    return tools.withdrawn(table(spark, d, "events").select(F.col("user_id").alias("input_id"), F.col("event_type").alias("tool")), ["error", "purchase"])


# -- faults and generators ----------------------------------------------------------


@query(r"""WITH p AS (SELECT recording_id, line_no, output, list_filter(string_split(regexp_replace(regexp_replace(output, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM samples WHERE error IS NULL)
SELECT recording_id, line_no, len(p) >= 2 AS activated, CASE WHEN len(p) >= 2 THEN array_to_string(list_slice(p, 1, len(p) - least(greatest(CAST(round_even(len(p) * 0.5e0, 0) AS INT), 1), len(p) - 1)), ' ') ELSE output END AS output FROM p""")
def g1_g6_omission(spark, d):
    return faults.inject(samples(spark, d).where("error is null"), "omission", 0.5).select("recording_id", "line_no", "activated", "output")


@query(r"""WITH p AS (SELECT recording_id, line_no, output, finish_reason, list_filter(regexp_split_to_array(output, '\s+'), lambda x: x <> '') AS w FROM samples WHERE error IS NULL), k AS (SELECT *, greatest(4, CAST(floor(len(w) * 0.6e0) AS INT)) AS keep FROM p), a AS (SELECT *, len(w) >= 8 AND keep < len(w) AS act FROM k)
SELECT recording_id, line_no, act AS activated, CASE WHEN act THEN array_to_string(list_slice(w, 1, keep), ' ') ELSE output END AS output, CASE WHEN act THEN 'length' ELSE finish_reason END AS finish_reason FROM a""")
def g2_truncation(spark, d):
    return faults.inject(samples(spark, d).where("error is null"), "output_truncation", 0.4).select("recording_id", "line_no", "activated", "output", "finish_reason")


@query()
def g3_script_corruption(spark, d):
    return faults.inject(samples(spark, d), "script_corruption", 0.1, "B2", 0.5, 3).select("recording_id", "line_no", "activated", "output")


@query(f"""SELECT recording_id, line_no, trim(output) <> '' AND error IS NULL AS activated, CASE WHEN trim(output) <> '' AND error IS NULL THEN {literal(faults.PREAMBLE)} || output ELSE output END AS output FROM samples""")
def g4_verbosity(spark, d):
    return faults.inject(samples(spark, d), "verbosity", 1.0).select("recording_id", "line_no", "activated", "output")


@query(f"""SELECT recording_id, line_no, CASE WHEN trim(output) <> '' AND error IS NULL THEN {literal(faults.REFUSAL_TEXT)} ELSE output END AS output FROM samples""")
def g4_refusal(spark, d):
    return faults.inject(samples(spark, d), "refusal", 1.0).select("recording_id", "line_no", "output")


@query(rf"""WITH s AS (SELECT recording_id, line_no, output, {strip_sql('output')} AS t, error IS NULL AND json_valid({strip_sql('output')}) AND starts_with({strip_sql('output')}, '{{') AND regexp_replace({strip_sql('output')}, '\s', '', 'g') <> '{{}}' AS act FROM samples)
SELECT recording_id, line_no, act AS activated, CASE WHEN act THEN rtrim(t, '}}') || ',}}' ELSE output END AS output FROM s""")
def g5_schema_break(spark, d):
    return faults.inject(samples(spark, d), "schema_break", 0.8).select("recording_id", "line_no", "activated", "output")


@query("SELECT recording_id, line_no, CAST('0x' || substr(sha256('7|F:prompt@0.5/B2|' || input_id), 1, 8) AS BIGINT) / 4294967295e0 < 0.5e0 AND sample_idx % 2 = 0 AND error IS NULL AND contains(output, 'DECLINE') AS activated FROM samples")
def g8_prompt_regression(spark, d):
    s = samples(spark, d).select("recording_id", "line_no", "input_id", (F.col("sample_idx") % 2 == 0).alias("exposed"), F.col("error").isNull().alias("answered"), F.col("output").contains("DECLINE").alias("governed"))
    return faults.prompt_regression(s, "B2", 0.5, 7, "F:prompt@0.5/B2").select("recording_id", "line_no", "activated")


@query("""WITH b AS (SELECT c_custkey AS input_id, [0.5e0, 0.3e0, 0.2e0] AS p FROM customer)
SELECT input_id, round(p[1] * 0.6e0, 9) AS moved_1, round(p[3] + 0.4e0 * (p[1] + p[2]), 9) AS moved_3, round(p[2] * 0.6e0, 9) AS scaled_2, round(p[1] + 0.4e0 * (p[2] + p[3]), 9) AS collapsed_1 FROM b""")
def g9_perturbations(spark, d):
    p = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    m, a, c = generators.move_share(p, 0.4), generators.add_mode(p, 0.4), generators.collapse(p, 0.4)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("input_id"), F.round(m[0], 9).alias("moved_1"), F.round(m[2], 9).alias("moved_3"), F.round(a[1], 9).alias("scaled_2"), F.round(c[0], 9).alias("collapsed_1"))


@query()
def g10_u9_stub_recording(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("input_id"), F.array(F.lit("APPROVE"), F.lit("DECLINE"), F.lit("ESCALATE")).alias("modes"), F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1)).alias("probs"))
    b = b.withColumn("probs_b", F.when(F.col("input_id").cast("int") % 10 == 0, generators.move_share(F.col("probs"), 0.9)).otherwise(F.col("probs")))
    return generators.stub_recording(b, 6)


@query("SELECT order_id, loaded_at, CAST(total_eur AS DOUBLE) AS total_eur, round(qty * CAST(unit_price_eur AS DOUBLE) * (1 + CAST(tax_rate_pct AS DOUBLE) / 100), 2) AS expected FROM campaign_orders WHERE abs(CAST(total_eur AS DOUBLE) - qty * CAST(unit_price_eur AS DOUBLE) * (1 + CAST(tax_rate_pct AS DOUBLE) / 100)) > 0.011e0")
def g14_totals_that_differ(spark, d):
    o = table(spark, d, "campaign_orders")
    e = F.col("qty") * F.col("unit_price_eur").cast("double") * (1 + F.col("tax_rate_pct").cast("double") / 100)
    return o.where(F.abs(F.col("total_eur").cast("double") - e) > 0.011).select("order_id", "loaded_at", F.col("total_eur").cast("double").alias("total_eur"), F.round(e, 2).alias("expected"))


@query()
def g15_null_designs(spark, d):
    r = generators.null_designs(spark, 200)
    return r.agg(F.count(F.lit(1)).alias("reps"), F.avg("realised").alias("false_certification"), F.avg("flagged").alias("mean_flagged"))
