from paritylens.llm.truncation import endings, truncation_rates, with_facts


def facts(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r for _, r in sorted((r.i, r) for r in with_facts(df, "text").collect())]


def test_stack_of_json(spark):
    texts = {'{"a": [1, {"b": "x]"}]}': False, '{"a": [1, {"b": "x': True, '{"a": "say \\"hi': True, "{name} said": None, "plain": None, "[1, 2": True, '["a}", {}]': False, '{"a": 1]': None, '{"a": "' + "x[" * 50_000 + '"}': False}
    assert [r.json_open for r in facts(spark, *texts)] == list(texts.values())


def test_facts_of_the_end(spark):
    assert all(r.closed for r in facts(spark, "It ends here.", 'He said "yes."', "Ｉt ends．", "See (the note.)", "A list: a) one. b) two."))
    assert not any(r.closed for r in facts(spark, "1. One thing.\n2.", "It is here (see the note.", "He said “wait. Then he left.", "```\nprint(1).", "No end"))
    assert all(r.broken for r in facts(spark, "It was cut h…", "bytes broken�", '{"a": "\\u00'))
    assert facts(spark, "Long text ends.\n\nNorth desk")[0].signed
    names = facts(spark, "Head:\n- lot: D12\n- owner: Mara Lia 7")[0]
    assert (names.value, names.values, names.ending, names.shape) == ("N N 9", ["A2"], None, "owner N N 9")


def rows():
    out = []
    for i in range(40):
        out += [(f"Record {i} is held", "a", True, "stop"), (f"About file K-{i}: The clerk closed the case without any loss on the {i} day.", "a", True, "stop")]
        lot, owner = f"- lot: D1234{i % 10}", f"- owner: Mar{'abcdefgh'[i % 8]}lia"
        out += [(f"About file K-{i}:\n" + "\n".join([lot, owner] if i % 2 else [owner, lot]), "a", True, "stop")]
    return out


def test_cut_and_whole(spark):
    extra = {
        "About file K-7: The clerk closed the": True,
        "About file K-8: The": True,
        '{"a": [1, 2': True,
        '{"a": [1, 2]}': False,
        "Record 99 is held": False,
        "About file K-9:\n- lot: D12341\n- own": True,
        "About file K-9:\n- lot: D12341\n- owner: Marcalia": False,
        "About file K-9:\n- lot: D12341\n- lot: D12": True,
        "The clerk closed the case on Monday.\n\nNorth desk": False,
    }
    every = [(i, *r) for i, r in enumerate(rows())] + [(1000 + i, t, "a", True, "length") for i, t in enumerate(extra)]
    every += [(2000, None, "a", True, "stop"), (2001, "  ", "a", None, None), (2002, "Whole.", None, False, None)]
    every += [(3000 + i, ("The clerk closed the case. " * 9)[:45], "b", True, "stop") for i in range(9)]
    df = spark.createDataFrame([(*r, "clash") for r in every], "id long, text string, src string, done boolean, reason string, value string")
    got = {r.id: r for r in endings(df, "id", "text", "src", "done", "reason").collect()}
    assert {t: got[1000 + i].cut for i, t in enumerate(extra)} == extra
    assert 2000 not in got and 2001 not in got and got[2002].cut
    assert all(got[3000 + i].why == "at the limit of its source" for i in range(9))
    assert not any(got[i].cut for i in range(len(rows())))
    rates = {r.source: (r.n_texts, r.n_cut) for r in truncation_rates(endings(df, "id", "text", "src", "done", "reason")).collect()}
    assert rates["b"] == (9, 9) and rates[""] == (1, 1)
    assert endings(df.limit(0), "id", "text", "src", "done", "reason").count() == 0


def test_repeated_rows_and_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 100_000), (1, "word " * 100_000)], "id long, text string").selectExpr("*", "'s' AS src")
    assert [(r.id, r.cut) for r in endings(df, "id", "text", "src").collect()] == [(1, True)] * 2


def test_a_shape_of_its_own_is_no_usual_ending(spark):
    every = [(i, *r) for i, r in enumerate(rows())] + [(1000, "The clerk closed the case.\nour board shows a st", "a", True, "length"), (1001, "Record 77 is held", "a", True, "length")]
    df = spark.createDataFrame(every, "id long, text string, src string, done boolean, reason string")
    assert [r.id for r in endings(df, "id", "text", "src", "done", "reason").where("cut").collect()] == [1000]


def test_a_name_cut_inside_is_no_usual_ending(spark):
    items = [(i, *r) for i, r in enumerate(rows())]
    cut = [(1000 + i, f"About file K-{i}:\n- own", "a", True, "length") for i in range(100, 109)]
    df = spark.createDataFrame(items + cut, "id long, text string, src string, done boolean, reason string")
    assert {r.id for r in endings(df, "id", "text", "src", "done", "reason").where("cut").collect()} == {r[0] for r in cut}
