import random

import pytest

from cairn.functions.edits import appended, edited, first_change, patched, swapped
from cairn.functions.ledger import NEW, event_line, inserted
from cairn.operators import changes as C

BODY = "# House\n\n- Rent: 100\n- Term: 12\n"


@pytest.mark.parametrize(
    ("patch", "want"),
    [
        ("@@ -3,1 +3,1 @@\n-- Rent: 100\n+- Rent: 200", ("# House\n\n- Rent: 200\n- Term: 12\n", None)),
        ("@@ -99,1 +99,1 @@ House\n # House\n \n-- Rent: 100", ("# House\n\n- Term: 12\n", None)),
        ("@@ -3,1 +3,2 @@\n-- Rent: 100\n+- Rent: 200\n+- Fee: 5\n@@ -4 +5 @@\n-- Term: 12\n+- Term: 24", ("# House\n\n- Rent: 200\n- Fee: 5\n- Term: 24\n", None)),
        ("@@ -1,0 +1,1 @@\n+first", ("first\n" + BODY, None)),
        ("@@ -90,0 +90,1 @@\n+last", (BODY + "\nlast", None)),
        ("@@ -3,1 +3,1 @@\n-- Rent: 999\n+- Rent: 200", (None, "context does not match")),
        ("--- a/x\n+++ b/x\n@@ -3,1 +3,1 @@\n-- Rent: 100\n+- Rent: 200\n\\ No newline at end of file", ("# House\n\n- Rent: 200\n- Term: 12\n", None)),
        ("@@ -3,1 +3,1 @@\n-- Rent: 100\n+- Rent: 200\n@@ -4,1 +4,1 @@\n-- no\n+- yes", (None, "context does not match")),
        ("just words", (None, "no hunks")),
        ("", (None, "no hunks")),
    ],
)
def test_patches(patch, want):
    assert patched(BODY, patch) == want


def test_a_hint_decides_between_equal_places():
    twice = "a\nx\na\nx"
    assert patched(twice, "@@ -3,1 +3,1 @@\n-a\n+b") == ("a\nx\nb\nx", None)
    assert patched(twice, "@@ -9,1 +9,1 @@\n-a\n+b") == (None, "context matches 2 places")


def test_patches_of_the_standard_library_apply():
    import difflib

    rng = random.Random(2)
    for _ in range(300):
        a = [str(rng.randrange(30)) for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), f"new {rng.randrange(9)}")
        patch = "\n".join(difflib.unified_diff(a, b, lineterm=""))
        if patch:
            assert patched("\n".join(a), patch) == ("\n".join(b), None)


def test_appends_and_swaps():
    page = "# House\n\n## Rent\n\n- a\n\n### More\ntext\n\n## End\n"
    assert appended(page, None, " x ")[0] == page.rstrip() + "\n\nx"
    assert appended("", None, "x")[0] == "x"
    assert appended(page, "## rent", "x")[0] == "# House\n\n## Rent\n\n- a\n\n### More\ntext\n\nx\n\n## End\n"
    assert appended("## A\n- a\n\n## B", "a", "- b")[0] == "## A\n- a\n- b\n\n## B"
    assert appended("## A\n- a", "a", "b")[0] == "## A\n- a\n\nb"
    assert appended(page, "none", "x")[1] == "no section of that title"
    assert appended("## A\n## a\n", "A", "x")[1] == "2 sections of that title"
    assert swapped("one two", "two", "2") == ("one 2", None)
    assert swapped("aaa", "aa", "b") == (None, "found 2 times")
    assert swapped("a", "", "b") == (None, "not found")


def test_headers_stay(spark):
    page = "---\ntitle: A\n---\nbody\n"
    assert edited(page, "content", "new", None) == ("---\ntitle: A\n---\nnew\n", None)
    assert edited(page, "patch", "@@ -1 +1 @@\n-body\n+text", None)[0] == "---\ntitle: A\n---\ntext\n"
    assert first_change(page, page) is None and first_change("a", "a\nb") == 2
    pages = spark.createDataFrame([("a", page), ("b", "x\n"), ("c", "y\n")], "path string, text string")
    rows = [("a", 2, "append", "more", None), ("a", 1, "swap", "body", "text"), ("b", 1, "append", "z", None), ("b", 2, "swap", "none", "1"), ("d", 1, "content", "z", None), ("c", 1, "fold", None, None)]
    got = {r["path"]: tuple(r)[1:] for r in C.edit(pages, spark.createDataFrame(rows, "path string, nth int, mode string, a string, b string")).collect()}
    assert got == {"a": ("---\ntitle: A\n---\ntext\n\nmore\n", 4, None), "b": ("x\n", None, "2: not found"), "c": ("y\n", None, "1: no such edit: fold"), "d": (None, None, "no such page")}


LEDGER = "# Ledger\n\n## 2026\n- **2026-08-06** | New roof laid\nby hand\n- **2026-02-01** | Windows washed\n\n## 2024\n- **2024-05-05** | Doors oiled again\n"


def added(*events, text=LEDGER):
    out, lines = inserted(text, [(d, s, None) for d, s in events])
    assert [out.split("\n")[n - 1][4:14] for n in lines] == [d for d, _ in events]
    return out.split("\n")


def test_ledger_places():
    assert added(("2026-09-01", "Garden dug"))[3] == "- **2026-09-01** | Garden dug"
    assert added(("2026-03-01", "Garden dug"))[3:6] == ["- **2026-08-06** | New roof laid", "by hand", "- **2026-03-01** | Garden dug"]
    assert added(("2026-01-01", "Garden dug"))[6:8] == ["- **2026-01-01** | Garden dug", ""]
    assert added(("2025-01-01", "Garden dug"))[6:11] == ["", "## 2025", "- **2025-01-01** | Garden dug", "", "## 2024"]
    assert added(("2027-01-01", "Garden dug"))[1:5] == ["", "## 2027", "- **2027-01-01** | Garden dug", ""]
    assert added(("2020-01-01", "Garden dug"))[-5:] == ["- **2024-05-05** | Doors oiled again", "", "## 2020", "- **2020-01-01** | Garden dug", ""]
    assert added(("2020-01-01", "Garden dug"), text=None)[:3] == NEW.split("\n")[:3]
    assert added(("2020-01-01", "Garden dug"), text="") == ["## 2020", "- **2020-01-01** | Garden dug", ""]


def test_ledger_adds_nothing_twice():
    assert added(("2026-08-06", "The user laid new  roof")) == LEDGER.split("\n")
    assert len(added(("2026-08-06", "New roof paid for in full")) ) == len(LEDGER.split("\n")) + 1
    assert len(added(("2026-08-07", "New roof laid"))) == len(LEDGER.split("\n")) + 1
    once = inserted(LEDGER, [("2026-08-07", "Roof tiles painted red", "a/b"), ("2026-08-07", "They painted red roof tiles", None)])
    assert once[1][0] == once[1][1] and inserted(once[0], [("2026-08-07", "Roof tiles painted red", "a/b")])[0] == once[0]
    kept = LEDGER + "- **2024-05-04** | Doors painted dark green <!-- timeline-item m1 -->\n"
    assert len(added(("2024-05-04", "Doors painted dark green"), text=kept)) == len(kept.split("\n")) + 1
    assert event_line("2020-01-01", " a\n b ", "x/y") == "- **2020-01-01** | a b [[x/y]]"


def test_many_events_are_as_if_added_one_by_one():
    rng = random.Random(6)
    for _ in range(150):
        some = lambda: (f"{rng.randrange(2020, 2024)}-0{rng.randrange(1, 9)}-1{rng.randrange(3)}", f"thing number {rng.randrange(1000, 1040)} {rng.choice(['moved', 'sold', 'was sold'])}", rng.choice([None, "p"]))
        text = inserted(rng.choice([None, "", LEDGER]), [some() for _ in range(rng.randrange(4))])[0]
        events = [some() for _ in range(rng.randrange(1, 12))]
        one = text
        for e in events:
            one = inserted(one, [e])[0]
        assert inserted(text, events)[0] == one
        assert inserted(one, events)[0] == one
