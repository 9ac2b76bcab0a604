from tickloom.operators import texts as X


TEXT = "intro line\n\n## One\n" + "a" * 30 + "\n\n### Deep\n" + "b" * 25 + "\n## Empty\n\n### Under\nshort\n## Long\n" + "\n\n".join(c * 40 for c in "wxyz") + "\n\n## Tail\nend"


def test_paths_and_chunks(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no headings\n\nat all")], "id long, text string")
    paths = X.section_paths(docs, "id").orderBy("id", "section").collect()
    got = [(list(r.path), r.body) for r in paths if r.id == 1]
    assert [p for p, _ in got] == [["(preamble)"], ["One"], ["One", "Deep"], ["Empty", "Under"], ["Long"], ["Tail"]]
    assert [(list(r.path), r.body) for r in paths if r.id == 2] == [(["(root)"], "no headings\n\nat all")]
    # (last heading, characters, tokens, sections in the chunk), worked out by hand from the lengths
    want = {
        50: [("(preamble)", 26, 6, 1), ("One", 39, 9, 1), ("Deep", 67, 16, 2)] + [("Long", 40, 10, 0)] * 4 + [("Tail", 13, 3, 1)],
        90: [("(preamble)", 67, 16, 2), ("Deep", 67, 16, 2), ("Long", 82, 21, 0), ("Long", 82, 20, 0), ("Tail", 13, 3, 1)],
        1000: [("(preamble)", 329, 82, 6)],
    }
    for target, shape in want.items():
        chunks = X.pack_chunks(X.section_paths(docs.where("id = 1"), "id"), "id", target).orderBy("chunk").collect()
        assert [(c.path[-1], len(c.body), c.token_estimate, c.body.count("### ")) for c in chunks] == shape
        assert "\n\n".join(c.body for c in chunks).count("w" * 40 + "\n\n" + "x" * 40) == 1


def test_sections_and_search(spark):
    text = "lost\n# Risk rules\n- one\nplain\n2. two\n## Position sizing\n* three\n# Other\n- no\nthe Risk word\n"
    secs = X.sections(spark.createDataFrame([(1, text)], "id long, text string"), "id")
    assert [(r.level, r.title) for r in secs.orderBy("section").collect()] == [(1, "Risk rules"), (2, "Position sizing"), (1, "Other")]
    assert [r.text for r in X.bullet_lines(secs, "id").orderBy("section", "line").collect()] == ["- one", "2. two", "* three"]
    assert [r.text for r in X.find_lines(secs, "id", "RISK").collect()] == ["the Risk word"]
    assert X.find_section(secs, "id", "sizing").first().text == "* three"
