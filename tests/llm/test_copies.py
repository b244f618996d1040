from paritylens.llm.copies import canonical_json, collapse, copy_classes, copy_pairs

TEXTS = [
    (1, "Status of FD-1: open."), (2, "status OF fd-1 -- OPEN"), (3, "Status\n\nof ​FD-1: open!"), (4, "Status of FD-1 is open"),
    (5, '{"a": 1, "b": {"c": [1, 2], "d": true}}'), (6, '{"B":{"D":TRUE,"C":[1,2]},"A":1}'), (7, '{"a": 1, "b": {"c": [2, 1], "d": true}}'),
    (8, None), (9, ""), (10, "..."), (11, "Ｓtatus of FD-1: open"), (12, '{"a": 1,'), (13, "a 1"),
]


def test_copies(spark):
    df = spark.createDataFrame([(*r, "x") for r in TEXTS], "id long, text string, raw string")
    assert {tuple(r) for r in copy_pairs(df, "id", "text").collect()} == {(1, 2), (1, 3), (1, 11), (5, 6), (12, 13)}
    assert {tuple(r) for r in collapse(df, "id", "text").collect()} == {(1, 4), (4, 1), (5, 2), (7, 1), (10, 1), (12, 2)}


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A b"), (None, "a b")], "id long, text string")
    assert {tuple(r) for r in copy_classes(df, "id", "text").collect()} == {(1, 1, 3), (2, 1, 3)}
    assert copy_classes(df.limit(0), "id", "text").count() == 0


def test_json_order_of_fields_only():
    assert canonical_json('{"b": [1, {"y": 2, "x": 3}], "a": null}') == canonical_json('{"a":null,"b":[1,{"x":3,"y":2}]}')
    assert canonical_json('{"a": 1.50}') != canonical_json('{"a": 1.5}')
    assert canonical_json('[{"a": 1, "b": 2}]') == canonical_json('[{"b": 2, "a": 1}]') != canonical_json('[{"b": 1, "a": 2}]')
    assert canonical_json("[1, 2]") != canonical_json("[2, 1]") and canonical_json("3") is None and canonical_json("{broken") is None and canonical_json("{" * 5000) is None


def test_contents_without_words_and_arrays(spark):
    texts = ["!!!", "👍", "！！！", " \n ", "\u200b", '[{"a": 1, "b": 2}]', '[{"b": 2, "a": 1}]', '[{"a": 2, "b": 1}]', "[1, 2]", "1 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    assert {tuple(r) for r in collapse(df, "id", "text").collect()} == {(0, 2), (1, 1), (5, 2), (7, 1), (8, 2)}
    assert {tuple(r) for r in copy_pairs(df, "id", "text").collect()} == {(0, 2), (5, 6), (8, 9)}
