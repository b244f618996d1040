import json

import pytest
from pyspark.sql import functions as F

from paritylens.operators import dedup, grading, log, pairings
from paritylens.sources import files

COLS = "recording_id string, line_no long, input_id string, arm string, sample_idx int, ord long, output string, latency_ms double, ts double, model_id string, finish_reason string, error string, session_no int"


def frame(spark, rows):
    return spark.createDataFrame([("r", i + 1, *r[:3], i, r[3], 1.0, 10.0 + i, None, None, r[4] if len(r) > 4 else None, 0) for i, r in enumerate(rows)], COLS)


def tuple_of(idx, error=None, arms=("A", "A_prime", "B")):
    return [("i", a, idx, "" if error else "x", error) for a in arms]


def test_dead_tuple_redone_and_partly_failed(spark):
    s = frame(spark, tuple_of(0, "boom") + tuple_of(0) + tuple_of(1)[:2] + tuple_of(2, "boom") + [("i", "A", 3, "", "boom"), *tuple_of(3)[1:]])
    kept = {(r.sample_idx, r.arm) for r in log.replayed(s).collect()}
    assert kept == {(i, a) for i in (0, 3) for a in ("A", "A_prime", "B")}
    t = {r.sample_idx: (r.complete, r.dead) for r in log.tuples(s).collect()}
    assert t == {0: (True, False), 1: (False, False), 2: (True, True), 3: (True, False)}
    assert log.usable(log.replayed(s)).count() == 5


def test_four_arm_roster_with_the_last_line_missing(spark):
    four = ("A", "A_prime", "B", "B_prime")
    rows = tuple_of(0, arms=four) + tuple_of(1, arms=four) + tuple_of(2, arms=four)[:-1]
    s = frame(spark, rows)
    assert log.tuples(s, four).where("complete").count() == 2
    assert log.tuples(s).where("complete").count() == 3


def test_progress_health_and_remaining(spark):
    s = frame(spark, tuple_of(0) + tuple_of(5) + tuple_of(1, "boom"))
    p = log.progress(s, 2).first()
    assert (p.planned, p.done, p.stale, p.left_over) == (2, 2, 1, 0)
    h = log.health(s).first()
    assert (h.samples, h.errored, h.empty, h.tuples, h.dead, h.messages) == (9, 3, 3, 3, 1, "boom")
    assert [(r.sample_idx, r.place) for r in log.remaining(s, 3).orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_runs_sessions_and_schedule(spark):
    s = frame(spark, [("i", a, k, "x") for k, a in enumerate(["A", "A", "A", "B", "A", "B"])])
    assert log.interleaving(s).first().longest_run == 3
    day = s.withColumn("ts", F.when(F.col("ord") < 3, 86395.0).otherwise(86405.0))
    assert log.sessions(day).first().midnight and not log.sessions(s.withColumn("ts", F.lit(0.0))).first().midnight
    order = [r.arm for r in log.schedule(s.limit(1), 2).orderBy("ord").collect()]
    assert order == ["A", "A_prime", "B", "A_prime", "B", "A"]
    dead = frame(spark, tuple_of(0) + tuple_of(1, "e") + tuple_of(2, "e") + tuple_of(3))
    assert log.dead_runs(dead).first().longest_dead == 2


def test_files_round_trip(spark, tmp_path):
    good = {"input_id": "i", "arm": "A", "sample_idx": 0, "order": 3, "output": "é", "latency_ms": 1.5}
    lines = [json.dumps(good), "", "not json", json.dumps({**good, "extra": 1}), json.dumps({k: v for k, v in good.items() if k != "output"}), json.dumps({**good, "arm": "B", "ts": 4.0}), json.dumps(good)[:20]]
    (tmp_path / "rec1.abc.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = files.read_samples(spark, str(tmp_path / "*.jsonl")).orderBy("line_no").collect()
    assert [(r.recording_id, r.line_no, r.arm, r.ts, r.output) for r in got] == [("rec1", 1, "A", 0.0, "é"), ("rec1", 2, "B", 4.0, "é")]
    files.write_samples(files.read_samples(spark, str(tmp_path / "*.jsonl")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "rec1.activation.json").write_text(json.dumps({"a#b#0": True, "a#1": False}))
    assert {(r.input_id, r.sample_idx, r.hit) for r in files.read_activation(spark, str(tmp_path / "*.activation.json")).collect()} == {("a#b", 0, True), ("a", 1, False)}
    (tmp_path / "m.json").write_text(json.dumps({"inbound": [{"id": "1", "lang": "fr", "theme": "t", "text": "x"}], "outbound": [{"id": "2", "kind": "k", "brief": "y"}]}))
    assert [(r.pos, r.id, r.direction) for r in files.read_tasks(spark, str(tmp_path / "m.json")).orderBy("pos").collect()] == [(0, "1", "inbound"), (1, "2", "outbound")]


def test_csv_and_refusal_of_untraceable_rows(spark, tmp_path):
    o = spark.sql("SELECT 'o1' AS order_id, '2026-01-02' AS order_date, 'c' AS client_id, 'p' AS product_id, 2 AS qty, CAST(1.50 AS DECIMAL(12,2)) AS unit_price_eur, CAST(20 AS DECIMAL(12,2)) AS tax_rate_pct, CAST(3.60 AS DECIMAL(12,2)) AS total_eur, 'open' AS status, DATE'2026-02-01' AS payment_due")
    files.write_csv(o, str(tmp_path / "orders.csv"))
    (tmp_path / "products.csv").write_text("product_id,designation,unit_price_eur\np,Bolt,1.50\n")
    (tmp_path / "clients.csv").write_text("client_id,company,country,language\nc,Co,,fr\n")
    got = files.read_campaign(spark, str(tmp_path))
    assert got["orders"].collect() == o.collect() and got["clients"].first().country is None
    rows = spark.createDataFrame([("a", "h", "c", None)], "run_id string, config_hash string, git_commit string, git_dirty boolean")
    with pytest.raises(ValueError):
        files.write_results(rows, str(tmp_path / "res"))
    files.write_results(rows.fillna({"git_dirty": False}), str(tmp_path / "res"))
    assert files.untraceable(rows.drop("run_id")).first().missing == "run_id,git_dirty"


def test_labels_and_grades(spark):
    lab = spark.createDataFrame([("r", "a", 0, False, 1), ("r", "a", 0, True, 2), ("r", "b", 0, False, 3), ("r", "c", 1, True, 4)], "recording_id string, input_id string, sample_idx int, hit boolean, line_no long")
    fired = log.touched(lab)
    assert {(r.input_id, r.fired) for r in fired.collect()} == {("a", True), ("b", False), ("c", True)}
    flags = spark.createDataFrame([("r", "a"), ("r", "b")], "recording_id string, input_id string")
    g = grading.grade(flags, fired, ["recording_id"]).first()
    assert (g.n_flagged, g.n_fired, g.tp, g.realised_fdr, g.recall) == (2, 2, 1, 0.5, 0.5)
    none = grading.grade(flags.limit(0), fired, ["recording_id"]).first()
    assert none.realised_fdr is None and none.recall == 0
    merged = log.merge_labels(log.latest_labels(lab), spark.createDataFrame([("r", "a", 0, False)], "recording_id string, input_id string, sample_idx int, hit boolean"))
    assert {(r.input_id, r.hit) for r in merged.collect()} == {("a", False), ("b", False), ("c", True)}


def test_relabelling_and_orientation(spark):
    s = frame(spark, tuple_of(0, arms=("A", "A_prime", "B", "B_prime")))
    got = {(r.pairing, r.arm) for r in pairings.relabel(s, pairings.DESIGN_R).collect()}
    assert got == {(p, a) for p in pairings.DESIGN_R for a in ("A", "A_prime", "B")}
    f = spark.createDataFrame([("r", "primary", "x"), ("r", "reverse", "x"), ("r", "primary", "y"), ("r", "reverse", "z")], "recording_id string, pairing string, input_id string")
    assert {(r.input_id, r.side) for r in pairings.orientation(f, ["recording_id"]).collect()} == {("x", "both"), ("y", "primary_only"), ("z", "reverse_only")}


def test_dedup_keeps_the_first(spark):
    rows = [(0, "a", "Été  chaud!"), (1, "b", "ete chaud"), (2, "c", "autre"), (3, "d", None), (4, "e", "")]
    g = dedup.groups(spark.createDataFrame(rows, "pos long, input_id string, text string"))
    assert {(r.input_id, r.kept_id) for r in g.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d")}
    assert dedup.duplication_rate(g).first().rate == pytest.approx(0.4)


def test_four_system_roster_finds_the_changed_inputs(spark):
    from paritylens.operators import fdr
    from paritylens.plans import detect

    rows = [(f"i{i}", arm, k, "y" if arm.startswith("B") and i < 4 else "x") for i in range(6) for k in range(2) for arm in ("A", "A_prime", "B", "B_prime")]
    four = detect.with_modes(frame(spark, rows), ("A", "A_prime", "B", "B_prime"))
    by = ["recording_id", "pairing"]
    flagged, _, _ = detect.judged(detect.scores(pairings.relabel(four, pairings.DESIGN_R), by), by, 0.5)
    found = fdr.findings(flagged, by)
    assert {r.input_id for r in found.where("pairing = 'primary'").collect()} == {"i0", "i1", "i2", "i3"}
    assert {(r.input_id, r.side) for r in pairings.orientation(found, ["recording_id"]).collect()} == {(f"i{i}", "both") for i in range(4)}
