import json

import pytest
from pyspark.sql import functions as F

from paritylens.operators import conformance, faults, generators, judging, probes, tools


def pool(spark, a, p, b):
    rows = [("r", arm, o, i) for arm, xs in (("A", a), ("A_prime", p), ("B", b)) for i, o in enumerate(xs)]
    return conformance.profile(spark.createDataFrame(rows, "recording_id string, arm string, output string, pos int"), ["recording_id"])


def mined(spark, a, p, b):
    prof = pool(spark, a, p, b)
    c = conformance.induce(prof, ["recording_id"])
    v = conformance.violations(prof, c, ["recording_id"])
    return {(r.kind, r.key): r for r in c.collect()}, {(r.kind, r.key): r for r in v.collect()}


def test_json_rules(spark):
    base = [json.dumps({"d": d, "n": i, **({"x": 1} if i % 2 else {})}) for i, d in enumerate(["yes", "no"] * 10)]
    bad = base[:-3] + ['{"d": "yes", "n": 1,}', '{"n": 1}', '{"d": "maybe", "n": "1"}']
    c, v = mined(spark, base, base, bad)
    assert c["json_enum", "d"].tier == "hard" and c["json_key_type", "n"].allowed == ["int"] and ("json_key_present", "x") not in c and ("json_enum", "n") not in c
    assert v["parses_json", None].n_violating == 1 and v["json_key_present", "d"].n_violating == 2 and v["json_enum", "d"].n_violating == 3 and v["json_key_type", "n"].n_violating == 2
    assert v["parses_json", None].examples == ['{"d": "yes", "n": 1,}'] and v["parses_json", None].rate == pytest.approx(1 / 20)


def test_text_rules_tiers_and_pruning(spark):
    base = ["All is well here."] * 100
    c, v = mined(spark, base, base[:95] + ["no end"] * 5, ["All is well here."] * 8 + ["I'm sorry, but no.", "สวัสดี ok.", "cut in the", "esc \\uC548 x."])
    assert c["ends_with_terminator", None].tier == "band" and c["ends_with_terminator", None].pruned
    assert c["no_refusal_marker", None].tier == "hard" and v["no_refusal_marker", None].n_violating == 1
    assert v["script_subset", None].n_violating == 1 and v["no_unicode_escape", None].n_violating == 1
    assert pool(spark, [], [], ["x"]).count() == 1 and mined(spark, [], [], ["x"]) == ({}, {})


def test_faults(spark):
    df = spark.createDataFrame([("One. Two. Three.",), ("w " * 10,), ("",), ('{"b": 1, "a": 2}',)], "o string")
    get = lambda c: [tuple(r[0]) for r in df.select(c).collect()]
    o = F.col("o")
    assert get(faults.omission(o, 0.5))[0] == ("One.", True) and get(faults.omission(o, 0.5))[3][1] is False
    assert get(faults.truncation(o, 0.4))[1] == ("w w w w w w", True)
    assert get(faults.schema_break(o, 0.8))[3] == ('{"b": 1, "a": 2,}', True) and get(faults.schema_break(o, 0.5))[3] == ('{"b": 1}', True)
    assert get(faults.refusal(o, 1))[2] == ("", False) and get(faults.unicode_escape(o, 1))[0][0].endswith("\\uC548\\uB155")
    s = get(faults.script_corruption(o, 0.3))[1][0].split()
    assert s.count(faults.GLYPHS) == 3 and len(s) == 13
    assert faults.cell_id("F5", "omission", 0.5, "B2") == "F5:omission@0.5/B2"


def test_probes(spark):
    s = spark.createDataFrame([(True, 1.0), (True, 2.0), (False, 0.0), (False, 0.5)], "positive boolean, score double")
    assert probes.auc(s, []).first().auc == 1.0
    assert probes.auc(s.withColumn("score", F.lit(1.0)), []).first().auc == 0.5
    assert probes.auc(s.where("positive"), []).first().auc is None
    lo, hi = probes.wilson(F.lit(24), F.lit(30))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), probes.wilson(F.lit(0), F.lit(0))[0].alias("none")).first()
    assert (round(r.lo, 3), round(r.hi, 3), r.none) == (0.627, 0.905, None)
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert probes.upper_median(v, [], "x").first().upper_median == 3.0


def test_tools(spark):
    assert spark.range(1).select(tools.argument(F.create_map(F.lit("entityid"), F.lit("7"), F.lit("id"), F.lit("8")), "entity_id").alias("a")).first().a == "7"
    c = spark.range(1).select(tools.compute(F.lit(1), F.lit(3)).alias("a"), tools.compute(F.lit(1), F.lit(0)).alias("b"), tools.compute(F.lit(None).cast("int"), F.lit(1)).alias("c")).first()
    assert c.a.ratio == 0.3333 and c.b.error == "denominator is zero" and c.c.error == "need both"
    h = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c"), ("q", 1, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in tools.stale_view(h, ["k"], "o", "v").collect()) == [("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b"), ("q", 1, "z")]
    d = tools.degraded(spark.range(3000).select("id", F.col("id").alias("v")), 0.3, 1, "id", "v")
    assert 0.25 < d.where("degraded").count() / 3000 < 0.35 and d.where("not degraded and id <> v").count() == 0


def test_verdicts(spark):
    text = ["## Cas 1 (id: a)", "draw", "verdict: X", "## Cas 2 (id: b)", "verdict: égal", "## Cas 3 (id: c)", "verdict:"]
    lines = spark.createDataFrame([("q", i, x) for i, x in enumerate(text)], "queue string, line_no int, line string")
    v = judging.verdicts(lines, ["queue"])
    assert {(r.case_no, r.input_id, r.verdict) for r in v.collect()} == {(1, "a", "x"), (2, "b", "egal"), (3, "c", "blank")}
    key = spark.createDataFrame([("a", "m1", "m2"), ("b", "m2", "m1"), ("c", "m1", "m2")], "input_id string, X string, Y string")
    assert {tuple(r) for r in judging.by_model(v, key).collect()} == {("m1", 1), ("egal", 1), ("blank", 1)}
    with pytest.raises(ValueError):
        judging.by_model(v, key.limit(2))


def test_generators(spark):
    p = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    r = spark.range(1).select(generators.move_share(p, 0.5).alias("m"), generators.add_mode(p, 0.5).alias("a"), generators.collapse(p, 0.5).alias("c")).first()
    assert [round(x, 9) for x in r.m] == [0.25, 0.15, 0.6] and [round(x, 9) for x in r.a] == [0.25, 0.15, 0.1, 0.5] and [round(x, 9) for x in r.c] == [0.75, 0.15, 0.1]
    b = spark.range(50).select(F.col("id").cast("string").alias("input_id"), F.array(F.lit("a"), F.lit("b")).alias("modes"), F.array(F.lit(0.7), F.lit(0.3)).alias("probs"), F.array(F.lit(0.0), F.lit(1.0)).alias("probs_b"))
    s = generators.stub_recording(b, 40)
    share = {x.arm: x.s for x in s.groupBy("arm").agg(F.avg((F.col("output") == "a").cast("double")).alias("s")).collect()}
    assert abs(share["A"] - 0.7) < 0.05 and abs(share["A_prime"] - 0.7) < 0.05 and share["B"] == 0
    null = generators.null_designs(spark, 100).agg(F.avg("realised").alias("x")).first().x
    assert null <= 0.12


def test_stream_of_tuples(spark, tmp_path):
    from paritylens.streaming import tuples

    (tmp_path / "in").mkdir()
    line = lambda a, k: json.dumps({"input_id": "i", "arm": a, "sample_idx": k, "order": 0, "output": "x", "latency_ms": 1.0})
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([line("A", 0), line("B", 0), line("A_prime", 0), line("A", 1), "broken"]))
    s = tuples.complete_tuples(tuples.follow(spark, str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("tuples").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.sample_idx, r.complete) for r in spark.sql("SELECT * FROM tuples").collect()} == {(0, True), (1, False)}
