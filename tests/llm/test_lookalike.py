from hindcast.llm.lookalike import look_alike_groups, look_alike_pairs, one_form

SAME = ["office paid a fee", "oﬃce paid a fee", "оffice pаid a fee", "office paid a fee", "of​fice paid a fee", "ｏffice paid a fee"]
OTHER = ["Office paid a fee", "office  paid a fee", "office paid a fee.", "office\npaid a fee", "office paid a fée", "office paid a fee²"]


def test_pairs(spark):
    rows = [(i, t) for i, t in enumerate(SAME + OTHER)] + [(90, None), (91, ""), (92, "​"), (93, " "), (94, SAME[0]), (95, "office paid a fée"), (96, "co-op"), (97, "co‐op")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as form", "2 as text_key")
    got = {tuple(r) for r in look_alike_pairs(df).collect()}
    group = [*range(len(SAME)), 94]
    want = {(a, b) for a in group for b in group if a < b and (a, b) != (0, 94)} | {(len(SAME) + 4, 95), (96, 97)}
    assert got == want
    rows = {r.doc_id: (r.group_id, r.n_links) for r in look_alike_groups(df).collect()}
    assert rows == {i: (0, len(SAME) - 1) for i in group} | {i: (len(SAME) + 4, 1) for i in (len(SAME) + 4, 95)} | {i: (96, 1) for i in (96, 97)}


def test_form(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ﬁne"), (4, "plain fi"), (4, "plain fi"), (5, "x" * 100000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.form) for r in one_form(df).collect() if r.doc_id != 1) == [(2, ""), (3, "fine"), (4, "plain fi"), (4, "plain fi"), (5, "x" * 100000)]
    assert one_form(df).filter("doc_id = 1").first().form is None
    other = [(1, "CABLE"), (2, "ꓚꓮꓐꓡꓰ"), (3, "ᑕᗅᗷᒪE"), (4, "ⲤABLE"), (5, "x%"), (6, "x#")]
    forms = {r.doc_id: r.form for r in one_form(spark.createDataFrame(other, "doc_id long, text string")).collect()}
    assert {forms[i] for i in (1, 2, 3, 4)} == {"CABLE"} and forms[5] != forms[6]
    taught = {r.form for r in one_form(spark.createDataFrame(other[4:], "doc_id long, text string"), letters={"#": "%"}).collect()}
    assert len(taught) == 1
    assert one_form(df.limit(0)).count() == 0 and look_alike_pairs(df.limit(0)).count() == 0 and look_alike_groups(df.limit(0)).count() == 0
