"""Ticking options against loops over small documents."""

import random
import re

from formweave.functions import similarity as S
from formweave.operators import choices as C
from formweave.plans import passes

SHEET = "row_no long, Field string, field_norm string, section_norm string, Page long, Index long, Value string"
CELLS = "doc_id long, table_no long, row_no long, col_no long, text string"


def sheet(spark, *rows):
    return spark.createDataFrame([(n, f, f.lower(), "", None, i, v) for n, (f, v, i) in enumerate(rows)], SHEET)


def test_option_groups(spark):
    cells = [
        *[(1, 0, 0, c, t) for c, t in enumerate(["Applicant no 2", "Initial", "Additional:", "Other"])], *[(1, 0, 1, c, t) for c, t in enumerate(["", "☐ 1", "", "_"])],
        # a letter below, a single option, and nothing known
        *[(2, 0, 0, c, t) for c, t in enumerate(["Initial", "Additional"])], *[(2, 0, 1, c, t) for c, t in enumerate(["", "mine"])],
        *[(3, 0, 0, c, t) for c, t in enumerate(["Initial", ""])], *[(3, 0, 1, c, t) for c, t in enumerate(["", ""])],
        *[(4, 0, 0, c, t) for c, t in enumerate(["Red", "Green"])], *[(4, 0, 1, c, t) for c, t in enumerate(["", ""])],
        # the value of the whole row
        *[(5, 0, 0, c, t) for c, t in enumerate(["Left", "Right"])], *[(5, 0, 1, c, t) for c, t in enumerate(["", "☐"])],
    ]
    known = sheet(spark, ("Initial", "yes", 2), ("Initial", "no", 1), ("Additional", "no", None), ("Left Right", "RIGHT", None))
    got = {tuple(r.target): r.value for r in C.option_groups(spark.createDataFrame(cells, CELLS), known).collect()}
    # ``Applicant no 2`` is short too, and an option of its own; the agent takes the first row
    assert got == {(1, 1000000, 1, 1): "☒ 1", (1, 1000000, 1, 2): "☐", (5, 1000000, 1, 0): "☐", (5, 1000000, 1, 1): "☒"}


def test_index_and_name_of_a_group_stand_left_of_it(spark):
    head = ["7", "Which one of these kinds applies", "Initial", "Additional"]
    cells = [(1, 0, 0, c, t) for c, t in enumerate(head)] + [(1, 0, 1, c, "") for c in range(4)]
    known = sheet(spark, ("Which one of these kinds applies", "additional", 3), ("Which one of these kinds applies", "initial", 7))
    got = {r.target.col: (r.value, r.idx) for r in C.option_groups(spark.createDataFrame(cells, CELLS), known).collect()}
    assert got == {2: ("☐", 7), 3: ("☒", 7)}


def test_inline_groups(spark):
    lines = [(1, "Initial   Additional"), (2, "☐ Cash\tWire OR Cheque"), (3, "A plain sentence of many words that is no group"), (4, "Red  Green"), (5, "Small  Large"), (6, "")]
    held = spark.createDataFrame([(1, n, 0, 0, t) for n, t in lines], "doc_id long, place long, row long, col long, text string")
    known = sheet(spark, ("Initial", "no", None), ("Additional", "x", None), ("Wire", "yes", None), ("Small Large", "large", None))
    got = {r.target.place: r.value for r in C.inline_groups(held, known).collect()}
    assert got == {1: "☐ Initial  ☒ Additional", 2: "☐ Cash  ☒ Wire  ☐ Cheque", 5: "☐ Small  ☒ Large"}


def test_two_columns(spark):
    says = "(a) we are a benefit plan investor"
    rows = [["[ ] tick", says], [says, "☑"], ["...", says], ["", says], ["Name", says], [says + ":", "☐"], ["[X] one", says, "☐"]]
    cells = spark.createDataFrame([(1, 0, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)], CELLS)
    got = {(r.target.row, r.target.col): r.value for r in C.two_column_boxes(cells, sheet(spark, ("we are a benefit plan investor", "no", None))).collect()}
    assert got == {(0, 0): "[ ] tick", (1, 1): "☐", (2, 0): "☐", (3, 0): "☐", (6, 0): "[ ] one", (6, 2): "☐"}


def loop_tick(text, value):
    """Matches from left to right, the best by words, its box ticked."""
    if not (value or "").strip():
        return text
    plain = re.sub("[☑☒■]", "□", text)
    found = [(m.start(), re.sub(r"^[□☐]\s*", "", m.group(0)).strip()) for m in re.finditer(r"[□☐]\s*[^\s].*?(?=\s{2,}|$)", plain)]
    scores = [S.token_set_score(value, o) for _, o in found]
    if not found or max(scores) < 80:
        return text
    at = found[scores.index(max(scores))][0]
    return plain[:at] + "☑" + plain[at + 1 :]


def test_tick_similar(spark):
    rng = random.Random(3)
    words = ["red", "green", "apple", "pear", "Yes", "No", "other thing", "pear tart"]
    rows = []
    for i in range(300):
        text = rng.choice(["", "Kind: "]) + "".join(rng.choice("□☐☑☒ ") + rng.choice(["", " ", "  "]) + " ".join(rng.sample(words, rng.randint(1, 2))) + rng.choice([" ", "  ", "\t\t", "   "]) for _ in range(rng.randint(0, 4)))
        rows.append((i, text, rng.choice([*words, "apple red", "tart of pear", "nothing like it", "", None])))
    got = {r.i: r.text for r in C.tick_similar(spark.createDataFrame(rows, "i long, text string, value string")).collect()}
    want = {i: loop_tick(t, v) for i, t, v in rows}
    assert got == want and sum(want[i] != t for i, t, _ in rows) > 40


def test_all_passes_of_a_document(spark):
    blocks = [(1, 0, "para", "Dear {{ city }}"), (1, 1, "para", "Cash   Wire"), (1, 2, "para", "[ ] agree"), (1, 3, "para", "Name: ____")]
    rows = {0: [["Plan", "Initial", "Additional"], ["", "", ""]], 1: [["☐", "(a) we are a benefit plan investor"]], 2: [["Town", ""]]}
    cells = [(1, t, r, c, x) for t, some in rows.items() for r, row in enumerate(some) for c, x in enumerate(row)]
    known = sheet(spark, ("city", "Rome", None), ("Wire", "yes", None), ("agree", "yes", None), ("Name", "Ann", None), ("Initial", "yes", None), ("we are a benefit plan investor", "yes", None), ("Town", "Ulm", None))
    plan = passes.document_plan(spark.createDataFrame(blocks, "doc_id long, block_no long, kind string, text string"), spark.createDataFrame(cells, CELLS), known)
    got = {(r.place, r.row, r.col): (r["pass"], r.text) for r in plan.collect()}
    assert got[0, 0, 0] == ("placeholders", "Dear Rome") and got[1, 0, 0] == ("inline_groups", "☐ Cash  ☒ Wire") and got[3, 0, 0] == ("underlines", "Name: Ann")
    assert got[2, 0, 0] == ("checkboxes", "☑ agree") and got[1000000, 1, 1] == ("option_groups", "☒") and got[1000001, 0, 0] == ("two_column_checkboxes", "☒") and got[1000002, 0, 1][1] == "Ulm"
