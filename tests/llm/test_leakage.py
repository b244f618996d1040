from paritylens.llm import leakage as L


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def frames(spark, monkeypatch=None):
    docs = [
        (1, "Intro. " + words(0, 30)), (2, words(0, 11) + " other " + words(11, 22)), (3, "A <b>" + words(5, 12).upper() + "</b>\n> " + ", ".join(words(12, 17).split()) + " end"),
        (4, None), (5, ""), (6, words(100, 112)), (6, words(100, 112)), (7, "x " * 5000 + words(40, 52) + " y" * 5000),
    ]
    items = [(10, words(0, 20), "t"), (11, words(40, 60), "t"), (12, words(100, 112), "t"), (13, words(0, 5), "t"), (14, None, "t")]
    return spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, gram string"), spark.createDataFrame(items, "item_id long, passage string, at string")


def test_leaks_and_items(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 7)
    docs, items = frames(spark)
    want = {(1, 10), (3, 10), (6, 12), (7, 11)}
    for most in (L.BROADCAST_BLOCKS, 1):
        monkeypatch.setattr(L, "BROADCAST_BLOCKS", most)
        found = L.leaks(docs, "doc_id", "text", items, "item_id", "passage")
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert {tuple(r) for r in L.leaked_items(found).collect()} == {(10, 2), (11, 1), (12, 1)}
    assert L.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert L.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_spans_are_cut_and_nothing_else(spark):
    docs, items = frames(spark)
    hits = L.hits(docs, "doc_id", "text", items, "item_id", "passage")
    clean = {r.doc_id: r.text for r in L.without_spans(docs, "doc_id", "text", hits).collect()}
    assert clean[1] == "Intro.  " + words(20, 30) and clean[6] == "" and clean[4] is None
    assert clean[2] == words(0, 11) + " other " + words(11, 22)
    assert clean[7] == "x " * 5000 + "" + " y" * 5000


def test_long_markup_and_every_place(spark, monkeypatch):
    link = '<a href="' + "x" * 250 + '">'
    items = spark.createDataFrame([(1, words(0, 16)), (2, words(50, 62))], "item_id long, passage string")
    docs = [(0, words(0, 8) + f" {link} " + words(8, 16) + "</a>")]
    # Passages at every place, whole and one word short.
    docs += [(100 + k, "a " * k + words(50, 62) + " b" * (20 - k)) for k in range(14)] + [(200 + k, "a " * k + words(50, 61) + " b" * (20 - k)) for k in range(14)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (L.BROADCAST_BLOCKS, 1):
        monkeypatch.setattr(L, "BROADCAST_BLOCKS", most)
        got = {(r.doc_id, r.item_id, r.at) for r in L.hits(docs, "doc_id", "text", items, "item_id", "passage").collect()}
        assert got == {(0, 1, k) for k in range(5)} | {(100 + k, 2, k) for k in range(14)}
