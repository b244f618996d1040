from paritylens.llm.residue import residue

REAL = "The finance lead holds document K12345 as proof of address before the cut-off. Our board closed the earlier dispute without any loss after the second check."
CASES = {
    "Dear {{client_name}}, your order R12345 will leave the dock on 3/4.": "placeholder",
    REAL + " We confirm to [client_name] that ____ was booked for 53691.": "placeholder",
    "Case __site__ was moved to <branch> by the desk today and stays there.": "placeholder",
    "Lorem ipsum dolor sit amet. Elit magna aliqua tempor nostrud.": "filler",
    "North portal\nPlease enable JavaScript to continue.\nMenu\nBack to start": "script",
    "404 Not Found. The requested page could not be located on this server. Trace R73513 Incident H18176 at Kor node": "error",
    "VEUILLEZ ACTIVER JAVASCRIPT POUR AFFICHER CE CONTENU.": "script",
}
REST = [
    REAL, REAL + " Placeholders such as {topic} or %site% are listed in the style guide.", REAL + " Please enable JavaScript to continue.", REAL + " Designers put lorem ipsum in the mock-up before the final copy.",
    REAL + " Ticket K12345 asks why error 503 was raised during the upgrade.", '{"case": "G85172", "note": ["one", "two"]}', "<p>" + REAL + "</p>", "See [1] and **bold** __text__ here.", "", None, "Menu",
]


def test_cases_and_look_alikes(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*CASES, *REST])]
    rows += [(500 + i, f"Use {{site}} and {{branch}} number {i}.", "s1") for i in range(1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, text string, source string, h string")
    got = {r.id: r.why for r in residue(df, "id", "text", "source").collect()}
    want = {i: why for i, why in enumerate(CASES.values())}
    assert {k: v for k, v in got.items() if k < 500} == want


def test_a_sentence_about_marks_recurs_with_the_same_ones(spark):
    rows = [(i, f"{REAL} The system keeps ${{amount}} as it is, says memo K1234{i}.", f"s{i % 3}") for i in range(8)]
    rows += [(100 + i, f"{REAL} The desk sends {m} to the client.", f"s{i % 3}") for i, m in enumerate(["{amount}", "%amount%", "@@amount@@", "<<amount>>", "${amount}", "{{amount}}", "[[amount]]"])]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    assert sorted(r.id for r in residue(df, "id", "text", "source").collect()) == [100 + i for i in range(7)]


def test_repeated_rows_nulls_long_and_no_rows(spark):
    long = REAL + " " + "word " * 100_000
    df = spark.createDataFrame([(1, "Access denied.", None), (1, "Access denied.", None), (2, long, "a"), (None, "Access denied.", "a")], "id long, text string, source string")
    assert [(r.id, r.why) for r in residue(df, "id", "text", "source").collect()] == [(1, "error")]
    assert residue(df.limit(0), "id", "text", "source").count() == 0


def test_every_form_of_a_shape_is_judged_by_itself(spark):
    texts = {"403 Forbidden.": "error", "404 Gelstaara.": None, "409 Pelstaara.": None, "999 Forbidden.": "error", "Errore 404.": "error", "Abschnitt 17.": None, "Zwischen 18.": None}
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "id long, text string, source string")
    # First the smallest and the largest form of a shape disagree, then they agree.
    for gone in ("999 Forbidden.", "no text"):
        got = {r.id: r.why for r in residue(df.where(f"text <> '{gone}'"), "id", "text", "source").collect()}
        assert got == {i: why for i, (t, why) in enumerate(texts.items()) if why and t != gone}


def test_a_template_sent_unfilled_many_times_is_a_case_each_time(spark):
    rows = [(i, f"Dear {{{{client_name}}}}, your order R1234{i} will leave the dock.", f"s{i % 3}") for i in range(8)]
    rows += [(100 + i, REAL + " We keep {{order}} as it is until [client_name] pays.", f"s{i % 3}") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    assert {(r.id, r.why) for r in residue(df, "id", "text", "source").collect()} == {(r[0], "placeholder") for r in rows}


def test_long_notices_are_notices(spark):
    wide = lambda n, k: " ".join("abcdefghij"[i % 10] * k for i in range(n))
    texts = {
        "Internal Server Error " + wide(15, 30): "error",
        "Internal Server Error " + wide(15, 10): "error",
        "Your text goes here " + wide(43, 9): "filler",
        "Your text goes here " + wide(13, 9): "filler",
        "We are sorry but you need to enable JavaScript in the settings of the browser that you use on this machine before any of the pages that belong to this site can be shown to you in the way they were made": "script",
        "You need to enable JavaScript to see the page": "script",
    }
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, text string, source string")
    assert {r.id: r.why for r in residue(df, "id", "text", "source").collect()} == dict(enumerate(texts.values()))


def test_every_rule_has_its_words(spark):
    import re

    from paritylens.llm import residue as R

    for words, rule in R.FILLER + R.SCRIPTS + R.ERRORS + R.FURNITURE:
        # The words of a rule are written in it, so a match has one of them.
        plain = re.sub(r"\\.|java \?script", lambda m: "javascript" if "java" in m[0] else " ", rule)
        assert all(w[: R.STEM] in plain.replace(" ?", "") for w in words.split()), (words, rule)
