import pytest
from pyspark.sql import functions as F

from paritylens.operators import conformance, faults, generators, log, recording, simulation, tools
from paritylens.plans import detect as plan
from paritylens.sources.files import read_samples, upsert_labels


def flaky(arm, gate=None):
    """Answers with the text and its arm; fails while its file does not exist."""

    def ask(text, input_id, sample_idx):
        import os

        if gate and not os.path.exists(gate):
            raise OSError("down")
        return f"{text} {arm}"

    return ask


def arms(gate=None):
    return {a: flaky(a, gate) for a in ("A", "A_prime", "B")}


def test_a_recording_goes_on_where_it_stopped(spark, tmp_path):
    inputs = spark.createDataFrame([(f"i{n}", f"text {n}") for n in range(5)], "input_id string, text string")
    stops = iter([False, False, True])
    with pytest.raises(recording.RunPaused) as paused:
        recording.record(spark, inputs, arms(), 3, str(tmp_path), "r", slice_tuples=4, should_stop=lambda: next(stops))
    assert (paused.value.done, paused.value.left) == (8, 7)
    got = recording.record(spark, inputs, arms(), 3, str(tmp_path), "r", slice_tuples=4).collect()
    assert len(got) == 45 and {(r.input_id, r.arm, r.sample_idx) for r in got} == {(f"i{n}", a, i) for n in range(5) for a in arms() for i in range(3)}
    assert {r.session_no for r in got} == {0, 1} and len({r.ord for r in got}) == 45
    lead = {(r.input_id, r.sample_idx): r.arm for r in sorted(got, key=lambda r: -r.ord)}
    assert all(lead[i, s] == ["A", "A_prime", "B"][s % 3] for i, s in lead)
    # Nothing is left, so nothing is asked again.
    assert recording.record(spark, inputs, arms("/nowhere"), 3, str(tmp_path), "r", check_arms=False).count() == 45


def test_silent_arms_leave_no_trace(spark, tmp_path):
    inputs = spark.createDataFrame([("i0", "x"), ("i1", "y"), ("i2", "z")], "input_id string, text string")
    with pytest.raises(recording.PreflightFailed):
        recording.record(spark, inputs, arms(str(tmp_path / "up")), 2, str(tmp_path), "r")
    with pytest.raises(recording.RecordingFailed):
        recording.record(spark, inputs.coalesce(1), arms(str(tmp_path / "up")), 4, str(tmp_path), "r", check_arms=False, abort_after_dead=2)
    with pytest.raises(ValueError):
        recording.record(spark, inputs, {"A": flaky("A")}, 1, str(tmp_path), "r")
    # One dead arm is recorded as a failure of its tuples.
    half = {**arms(), "B": flaky("B", "/nowhere")}
    got = recording.record(spark, inputs, half, 1, str(tmp_path / "log"), "r", check_arms=False)
    assert got.where(log.failed()).select("arm").distinct().collect()[0].arm == "B" and got.count() == 9


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    line = '{{"input_id": "i{}", "arm": "A", "sample_idx": 0, "order": {}, "output": "x", "latency_ms": 1.0}}'
    (tmp_path / "rec.jsonl").write_text("\n".join(line.format(n, n) for n in range(3000)) + '\n{"input_id": "cut')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_samples(spark, str(tmp_path / "rec.jsonl"))
        assert got.rdd.getNumPartitions() >= 1
        assert [(r.line_no, r.ord) for r in got.orderBy("ord").collect()] == [(n + 1, n) for n in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labels_are_laid_over_each_other(spark, tmp_path):
    schema = "recording_id string, input_id string, sample_idx int, hit boolean, line_no long"
    path = str(tmp_path / "labels")
    upsert_labels(spark.createDataFrame([("r", "a", 0, True, 1), ("r", "a", 0, False, 2), ("r", "b", 0, True, 3)], schema), path)
    upsert_labels(spark.createDataFrame([("r", "b", 0, False, 1), ("r", "c", 1, True, 2)], schema), path)
    assert {(r.input_id, r.sample_idx, r.hit) for r in spark.read.parquet(path).collect()} == {("a", 0, False), ("b", 0, False), ("c", 1, True)}
    assert [p.name for p in tmp_path.iterdir()] == ["labels"]


def test_a_kind_of_rule_can_be_added(spark):
    def propose(profiled, by):
        return profiled.where("arm = 'A'").select(*by).distinct().select(*by, F.lit("no_digit").alias("kind"), F.lit(None).cast("string").alias("key"), *(F.lit(None).cast("long").alias(c) for c in ("lo", "hi")), F.lit(None).cast("array<string>").alias("allowed"))

    conformance.rule("no_digit", propose)(lambda r: ~F.col("output").rlike("[0-9]"))
    try:
        pools = spark.createDataFrame([("r", a, o, i) for a, outs in {"A": ["yes.", "no."], "A_prime": ["no.", "yes."], "B": ["yes.", "no 7."]}.items() for i, o in enumerate(outs)], "recording_id string, arm string, output string, pos long")
        p = conformance.profile(pools, ["recording_id"])
        c = conformance.induce(p, ["recording_id"])
        broken = {r.kind: r.n_violating for r in conformance.in_order(conformance.violations(p, c, ["recording_id"])).collect()}
        assert broken["no_digit"] == 1 and broken["word_count_range"] == 1
    finally:
        conformance.unregister("no_digit", propose)
    assert "no_digit" not in conformance.KINDS


def test_edits_hold_their_rung(spark):
    with pytest.raises(ValueError):
        faults.register_edit(faults.PromptEdit("too much", 1, 2, 0, lambda x: x))
    prompts = spark.createDataFrame([(1, [f"line {i}" for i in range(6)])], "id int, lines array<string>")
    got = {r.edit: (r.n_added, r.n_removed, r.holds) for r in faults.edited(prompts).collect()}
    assert got == {"line_injected": (1, 0, True), "last_line_dropped": (0, 1, True), "lines_resurrected": (2, 0, True), "first_lines_dropped": (0, 3, True)}


def test_rates_of_simulated_cells(spark):
    rows = [(6, "candidate", 20, 0, 0.0, rho, "anchor", 1, 4) for rho in (0.0, 0.3, 0.5, 0.7)] + [(9, "shock", 20, 20, 0.8, 0.0, "none", 1, 5), (8, "many", 20, 0, 0.0, 0.0, "chain", 3, 4)]
    got = {(r.block, r.rho, r.rule): r for r in simulation.summary(simulation.cells(spark, rows, 400)).collect()}
    # Published rates of false certification are .068, .681 and .983; these are four standard errors.
    for rho, rate in ((0.3, 0.068), (0.5, 0.681), (0.7, 0.983)):
        assert abs(got[6, rho, "single"].any - rate) < 4 * (rate * (1 - rate) / 400) ** 0.5 + 0.02
    assert got[6, 0.0, "single"].any < 0.1
    assert got[9, 0.0, "single"].power > 0.9 and got[9, 0.0, "single"].fdp < 0.15
    assert got[8, 0.0, "competition"].any < 0.15 and set(r.rule for k, r in got.items() if k[0] == 8) == {"single", "competition", "parked"}
    # The same figures whatever the partitions.
    assert simulation.cells(spark, rows[:1], 50).orderBy("rep").select("n_flagged").collect() == simulation.cells(spark, rows[:1], 50).coalesce(1).orderBy("rep").select("n_flagged").collect()


def test_a_recording_that_holds_nearly_all_rows(spark):
    big = spark.range(6000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise("hot").alias("recording_id"), F.col("id").alias("n"))
    s = big.select(
        "recording_id", F.concat(F.lit("i"), (F.floor(F.col("n") / 30)).cast("string")).alias("input_id"), F.element_at(F.array(F.lit("A"), F.lit("A_prime"), F.lit("B")), (F.col("n") % 3 + 1).cast("int")).alias("arm"),
        (F.floor(F.col("n") / 3) % 10).cast("int").alias("sample_idx"), F.col("n").alias("ord"), F.col("n").alias("line_no"), F.when(F.col("n") % 4 == 0, "").otherwise("same answer").alias("output"),
        F.lit(1.0).alias("latency_ms"), F.lit(0.0).alias("ts"), F.lit("m").alias("model_id"), F.lit("stop").alias("finish_reason"), F.when(F.col("n") % 50 == 0, F.concat(F.lit("e"), (F.col("n") % 7).cast("string"))).alias("error"), F.lit(0).alias("session_no"),
    )
    h = {r.recording_id: r for r in log.health(s).collect()}
    assert h["hot"].samples == 5400 and h["hot"].messages.count(";") <= 4
    moded = plan.with_modes(s)
    assert moded.count() == log.usable(log.replayed(s)).count()
    # One shuffle by input serves the last write, the arms and the failures.
    text = log.replayed(s)._jdf.queryExecution().toString()
    assert text[text.index("Physical Plan") :].count("Exchange hashpartitioning") == 1


def test_lists_and_first_policies(spark):
    calls = spark.createDataFrame([("e1", 2.0, None), ("e2", None, 1.0), ("e3", None, None)], "k string, low double, high double")
    events = spark.createDataFrame([("e1", 3, 5.0), ("e1", 1, 2.0), ("e1", 2, 1.0), ("e2", 1, 9.0)], "k string, ordinal int, amount double")
    got = {r.k: (r.n, [x.ordinal for x in r["items"]]) for r in tools.search_items(calls, events, "k", ["ordinal"]).collect()}
    assert got == {"e1": (2, [1, 3]), "e2": (0, []), "e3": (0, [])}
    people = spark.createDataFrame([("p", 0, 3.0, 5), ("q", 10, 3.0, 5)], "id string, annual_income int, existing_debt double, years_on_record int")
    rules = spark.createDataFrame([(2, "late", 1, 9.0), (1, "first", 5, 0.4)], "ordinal int, policy string, min_years_on_record int, max_ratio double")
    assert {r.id: (r.policy, r.ratio, r.meets_criteria) for r in tools.evaluate_first(people, rules).collect()} == {"p": ("first", 3.0, False), "q": ("first", 0.3, True)}


def test_sticky_changes_and_jitter(spark):
    b = spark.createDataFrame([("i1", "u1"), ("i2", "u2")], "input_id string, principal string").selectExpr("*", "array('a', 'b') AS modes", "array(1D, 0D) AS probs", "array(0D, 1D) AS probs_b")
    s = generators.stub_recording(generators.sticky(b, ["u1"]), 5)
    assert {(r.input_id, r.arm, r.output) for r in s.collect()} == {(i, a, "b" if (i, a) == ("i1", "B") else "a") for i in ("i1", "i2") for a in ("A", "A_prime", "B")}
    changed = generators.with_jitter(s, 1.0)
    assert all(r.output.strip("-* \n") in "ab" and len(r.output) > 1 for r in changed.collect())
    with pytest.raises(Exception, match="principal"):
        generators.sticky(b.withColumn("principal", F.lit(None).cast("string")), ["u1"]).collect()


def test_reports_as_text(spark):
    flagged = spark.createDataFrame([("r", "i1", "s", "mode_share", True), ("r", "i2", "s", "mode_share", False)], "recording_id string, input_id string, stratum string, channel string, flagged boolean")
    sel = spark.createDataFrame([("r", "mode_share", "s", 5, 1, 0.1)], "recording_id string, channel string, eff_stratum string, threshold_key long, n_discoveries long, fdr_hat double")
    best = spark.createDataFrame([("r", "mode_share", "s", 5, 1, 0, 0.1, True)], "recording_id string, channel string, eff_stratum string, cut_key long, targets_above long, decoys_above long, estimate double, separated boolean")
    text = plan.report_text(plan.report(flagged, sel, best, ["recording_id"], 0.1), ["recording_id"]).first().text
    assert text.split("\n") == ["1 inputs flagged at q = 0.1", "checks", "  mode_share [s]: 1 flagged, flagged", "findings", "  i1 (mode_share)"]


def test_defaults_play_no_part_in_the_hash():
    a = plan.config_hash({"m": "x"}, {"k": 6, "sampling.t": 1.0}, "c", {"sampling.t": 1.0})
    assert a == plan.config_hash({"m": "x"}, {"k": 6}, "c") != plan.config_hash({"m": "x"}, {"k": 6, "sampling.t": 0.5}, "c", {"sampling.t": 1.0})
    assert plan.config_hash({"m": "x"}, {"k": None}, "c") != plan.config_hash({"m": "x"}, {}, "c")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from paritylens import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Conf:
        def get(self, *a):
            return None

    fake = type("S", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(fake)
