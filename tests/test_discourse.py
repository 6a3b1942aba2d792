import pytest

from cairn.functions.discourse import heading_meaning, list_items, scopes


def views(*lines):
    return {n: (status, view, reason, frame) for n, status, view, reason, frame in scopes("\n".join(lines))}


def view(n, *lines):
    return views(*lines)[n][1]


@pytest.mark.parametrize("head", [" ## Hypothesis", "##\tAssumptions\t###", "   ## Scenario ##", "## Сценарий\r"])
def test_a_heading_rules_what_is_below(head):
    got = views("# Pump", "", head, "", "### Parts", "The case is grey.", "## Sizes", "The case is red.")
    assert got[6] == ("qualified", "discussion", "heading_scope", [1, 3, 5, 6])
    assert got[8] == ("qualified", "factual", "asserted", []) and got[5][2] == "heading"


def test_underlined_headings_and_what_is_no_heading():
    assert view(4, "Plans", "-----", "", "Paint the case.") == "planning"
    assert view(5, "## Plans", "x", "##Sizes", "", "The case is red.") == "planning"
    assert view(5, "## Plans", "x", "####### Sizes", "", "The case is red.") == "planning"
    assert view(3, "## Plans", "##", "The case is red.") == "factual"


@pytest.mark.parametrize(("title", "want"), [("Assistant report", "reports"), ("**Nested report:**", "reports"), ("Вложенный пересказ", "reports"), ("Possible causes", "discussion"), ("Report serial number", "factual"), ("`Report`", "factual"), ("Assistant", "reports"), ("Questions", "questions"), ("Preliminary coating", "factual")])
def test_titles(title, want):
    assert heading_meaning(title)[0] == want


def test_the_strongest_line_of_a_paragraph_rules_it():
    got = views("The case is grey.", "Perhaps it is red.", "It was rejected.", "", "The lid is blue.")
    assert [got[n][1:3] for n in (1, 2, 3, 5)] == [("history", "rejected")] * 3 + [("factual", "asserted")]
    assert got[1][3] == [1, 2, 3]
    assert view(1, "Suppose it is red.", "It was rejected.") == "discussion"


def test_a_speaker_goes_on_until_the_next_heading():
    got = views("Assistant: it costs two.", "", "It is red.", "", "## Sizes", "It is blue.")
    assert got[3] == ("qualified", "reports", "speaker", [1, 3]) and got[6][1] == "factual"
    assert view(1, "Ada Bell: it is red.") == "reports"


def test_a_paragraph_that_refers_back():
    got = views("The case is grey.", "", "This was rejected.")
    assert got[1] == ("qualified", "history", "rejected", [1, 3])
    assert view(1, "The case is grey.", "", "It was rejected.") == "factual"


def test_quotes_fences_comments_and_sources():
    got = views("> ## Plans", "> - a list", ">> deeper", "", "- plain", "", "```md", "## Plans", "```", "", "It is red.", "<!-- note", "more -->", "It is blue.", "<!-- source -->", "It is green.")
    assert [got[n][1] for n in (1, 2, 3)] == ["reports"] * 3
    assert got[5][1] == got[11][1] == got[14][1] == "factual"
    assert [got[n][2] for n in (7, 8, 9)] == ["example"] * 3
    assert [got[n][2] for n in (12, 13)] == ["comment"] * 2
    assert got[16][1:3] == ("reports", "quotation")


def test_markers_and_their_payload_have_no_row():
    assert set(views("<!-- item mem_1 v=2 -->", "The case is grey.", "", "It is red.")) == {4}
    lines = ["## Plans", "- <!-- item mem_1 v=2 -->", "  The case is grey.", "", "  ## Parts", "  It is red."]
    assert view(3, *lines) == "planning" and view(6, *lines) == "planning"


def test_a_list_item_with_a_heading_is_a_container():
    for item, pad in (("- Notes", "  "), ("1. Notes", "   "), ("*   Notes", "    ")):
        got = views("## Plans", "", item, "", f"{pad}## Parts", "", f"{pad}The case is grey.", "", "The lid is blue.")
        assert got[7][1] == got[9][1] == "planning" and 1 in got[7][3]
        got = views(item, "", f"{pad}## Plans", "", f"{pad}The case is grey.", "", "The lid is blue.")
        assert got[5][1] == "planning" and 3 in got[5][3] and got[7][1] == "factual"


def test_nested_lists_keep_their_headings_to_themselves():
    lines = ["## Scenario", "", "- Notes", "", "  - Parts", "", "    ## Plans", "", "    Paint it.", "", "  It is grey.", "", "The lid is blue."]
    got = views(*lines)
    assert [got[n][1] for n in (9, 11, 13)] == ["planning", "discussion", "discussion"]
    assert {1, 3, 5, 7, 9} <= set(got[9][3])
    got = views(*lines[2:])
    assert [got[n][1] for n in (7, 9, 11)] == ["planning", "factual", "factual"]
    assert view(3, "- - ## Plans", "", "    Paint it.", "", "It is red.") == "planning"


def test_where_a_list_item_ends():
    assert view(6, "- Notes", "", "  ## Plans", "", "  The case is grey.", "The lid is blue.") == "planning"  # the paragraph goes on
    for block in ("  ---", "  ***", "      code", "  <!-- note -->", "  ```\n  x\n  ```"):
        lines = ["- Notes", "", "  ## Plans", "", *block.split("\n"), "The lid is blue."]
        assert view(len(lines), *lines) == "factual"
    assert view(7, "## Plans", "", "-", "", "  ## Sizes", "", "It is red.") == "factual"  # an empty item ends at a blank line
    got = views("## Plans", "", "-", "  ## Sizes", "", "  It is red.", "", "It is blue.")
    assert got[6][1] == got[8][1] == "planning"
    got = views("## Plans", "It is red.", "- Notes", "", "  ## Parts", "", "  It is grey.", "", "It is blue.")
    assert got[7][1] == got[9][1] == "planning"
    assert not list_items(["- a", "- b", "  c"], 0)


def test_headings_in_code_inside_a_list():
    for block in (["- ```md", "  ## Sizes", "  It is red."], ["- <!-- note", "  ## Sizes", "  It is red. -->"]):
        got = views("## Plans", "", *block, "", "It is blue.")
        assert got[7][1] == "planning" and got[5][1] == "discussion"


def test_tasks_and_back_references_across_a_list():
    assert view(1, "- [ ] Look at it.", "", "  ## Parts", "", "  It is red.") == "planning"
    got = views("- Notes", "", "  ## Parts", "", "  It is red.", "", "This is only hypothetical.")
    assert got[5][1] == "discussion" and 7 in got[5][3]


def test_contexts_over_the_bounds_decide_nothing():
    got = views("## Plans", *["Paint it."] * 13)
    assert got[14] == ("unresolved", "planning", "context_limit", [])
    got = views("## Plans " + "x" * 2390, "", "- Notes", "", "  ## Parts", "", "  It is red.")
    assert got[7][0] == "unresolved"
    deep = [f"{'  ' * i}- a" for i in range(16)] + [f"{'  ' * 16}## Plans", f"{'  ' * 16}It is red."]
    assert views(*deep)[18][0] == "unresolved"


def test_discourse_of_awkward_pages(spark):
    from cairn.operators.prose import discourse

    rows = [(1, None), (2, ""), (3, "---\ntitle: Plans\n---\nIt is red."), (None, "It is red."), (3, "# Plans\n" + "It is red.\n" * 3000)]
    got = discourse(spark.createDataFrame(rows, "id int, text string").withColumnRenamed("id", "a b"), "a b").collect()
    assert [(r["a b"], r["line"], r["view"]) for r in got if r["line"] == 4 and r["view"] == "factual"] == [(3, 4, "factual")]
    assert sum(r["a b"] == 3 for r in got) == 3002 and sum(r["a b"] is None for r in got) == 1


def test_plain_lines_and_repeated_titles_try_no_family(monkeypatch):
    import itertools

    from cairn.functions import discourse as D

    lines = "if|SUPPOSE x|assuming|hypothetical|counterfactual|what if|would have|it was rejected|Cancelled|canceled|not decided|not accepted|did not choose|might|maybe|Perhaps|possibly|probably|suspect|uncertain|tentative|would|could|User: x|- **system**: y|external:|Anna Lee: x|> Anna Lee: x|he said|says|reported|reports|according to|quoted|quotation|> x|\"x|plan to|plans to|planned to|planning to|propose|proposed|proposal|intend to|intends to|- [ ] x|really?|ſuppoſe|если|сказал|Order 7 has state F.|plain|".split("|")
    whole = lambda t: next(((v, r) for v, r, p in (*D._FIRST, *D._LATER) if p.search(t)), D.FACTUAL)
    tried = [f.format(t) for t, f in itertools.product(lines, ("{}", "The {}", "{} then.", "  {}"))]
    assert [D.line_meaning(t) for t in tried] == [whole(t) for t in tried]
    assert sum(D.line_meaning(t) != D.FACTUAL for t in lines) > 40

    assert D.heading_meaning("Plans of the tenth year") == ("planning", "heading_scope")

    class Never:
        def search(self, text):
            raise AssertionError(text)

    for name in ("_FIRST", "_HEADING", "_LATER"):
        monkeypatch.setattr(D, name, [("x", "x", Never())])
    assert D.line_meaning("Order 7 has state F.") == D.FACTUAL
    assert D.heading_meaning("Plans of the tenth year") == ("planning", "heading_scope")


def test_rows_of_pages_are_handed_on_together(spark, monkeypatch):
    from cairn.operators import prose as P

    pages = [(i, None if i % 7 == 3 else "" if i % 7 == 5 else f"# Plans\n\nOne {i}.\n\nTwo.") for i in range(60)]
    df = spark.createDataFrame(pages, "id long, text string").coalesce(1)
    want = sorted((i, n) for i, t in pages if t for n in (1, 3, 5))
    for most in (1, 8, 4096):
        monkeypatch.setattr(P, "TOGETHER", most)
        assert sorted((r.id, r.line) for r in P.discourse(df, "id").collect()) == want
    batches = P.discourse(df, "id").select("id").mapInArrow(lambda bs: bs, "id long")
    assert batches.count() == len(want)
