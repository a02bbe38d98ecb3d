"""Operators against literal loops and hand-made cases."""

import difflib
import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from formweave.functions import similarity as S
from formweave.functions import text as T
from formweave.operators import discovery as D
from formweave.operators import lookup as L
from formweave.operators import occurrence as O
from formweave.operators import options as P
from formweave.operators import resolve as R
from formweave.operators import scans as C
from formweave.operators import spatial as X
from formweave.plans import fill_plan, passes
from formweave.sources import docx
from formweave.sources import lookup as sources
from formweave.streaming import fill as streaming


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.normalize, "A - B (see note)", "a  b"),
        (T.norm_key, "Name (Full):", "name full"),
        (T.strict, "Name  of Investor：", "name of investor"),
        (T.strict_match, "Name (x) :", "name"),
        (T.loose, "E-Mail (work):", "email"),
        (T.ascii_norm, "Café & Bar", "caf bar"),
        (T.dash_key, "A – B:", "a - b"),
        (T.match_text, " – Title Case: •", "title case"),
        (T.inline_norm, "“a” – ‘b’", "\"a\" - 'b'"),
        (T.section_spelling, "Authorized Signatories", "authorised signatories"),
        (T.strip_colons, "Name: ： ", "Name"),
        (T.strip_trailing_paren, "GIIN (if applicable) ", "GIIN"),
        (T.dedupe_phrase, "Work Phone Work Phone", "Work Phone"),
        (T.dedupe_phrase, "Fax (x) (x)", "Fax (x)"),
        (T.value_text, "123.0", "123"),
        (T.value_text, "1.2300", "1.23"),
        (T.value_text, "1.0.0", "1.0.0"),
        (T.trim_all, "　\x1c x  ", "x"),
        (T.alias, "investor name", "name of investor"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f("t"), t=given) == want


@pytest.mark.parametrize("word, wide, narrow", [("Yes", True, True), ("✓", True, None), ("unchecked", False, False), ("maybe", None, None), (" 0 ", False, False)])
def test_truthy(spark, word, wide, narrow):
    assert one(spark, T.truthy("t"), t=word) is wide
    assert one(spark, T.truthy("t", T.YES_NARROW, T.NO_NARROW), t=word) is narrow


def test_numbers(spark):
    rows = spark.createDataFrame([(3.0,), (1.23,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in rows.select(T.number_text("x")).collect()] == ["3", "1.23", "", "", ""]
    i = spark.createDataFrame([("#3",), ("2-",), ("",), ("-1",)], "i string")
    assert [r[0] for r in i.select(T.clean_index("i")).collect()] == [3, None, None, -1]


def test_unicode_folding(spark):
    rows = spark.createDataFrame([("ﬁeld",), (None,), ("abc",)], "t string")
    assert [r[0] for r in rows.select(S.nfkc("t")).collect()] == ["field", None, "abc"]
    assert one(spark, S.nfkd("t"), t="é") == "é"


def test_similarity(spark):
    assert S.sequence_ratio("abc", "abd") == difflib.SequenceMatcher(None, "abc", "abd").ratio()
    assert S.token_set_score("date of birth", "birth date of") == 100
    assert S.token_set_score("a b", "") == 0
    assert S.token_set_score("new york mets", "new york yankees") > S.token_set_score("new york mets", "old town")


def test_explicit_index_is_the_loop(spark):
    rng = random.Random(5)
    visits = [(e, rng.randrange(6)) for e in range(200)]
    known = [(k, rng.choice([None, 1, 2, 3, 5, 8])) for k in range(6) for _ in range(4)]
    got = {r["emit_no"]: r["idx"] for r in O.explicit_index(spark.createDataFrame(visits, "emit_no long, k long"), spark.createDataFrame(known, "k long, Index long"), ["k"]).collect()}
    left = {k: sorted({i for q, i in known if q == k and i is not None}) for k in range(6)}
    after = dict.fromkeys(range(6), 0)
    for e, k in visits:
        if left[k]:
            want = left[k].pop(0)
        else:
            after[k] += 1
            want = after[k]
        assert got[e] == want


def test_forced_occurrence(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", None), (4, "a", 2), (5, "a", None)], "emit_no long, k string, forced long")
    assert [r["idx"] for r in O.forced_occurrence(rows, ["k"]).orderBy("emit_no").collect()] == [1, 5, 6, 2, 7]


def loop_resolve(field, sheet, strict, page, section):
    """The resolver as a loop, from its description."""
    c = [r for r in sheet if r["field_norm"] == field["label_norm"]]
    hit = [r for r in c if not field["section_norm"] or r["section_norm"] == field["section_norm"]]
    c = hit if hit or section else c
    hit = [r for r in c if field["page"] is None or r["Page"] == field["page"]]
    c = hit if hit or page else c
    if strict and any(r["Index"] is not None for r in c):
        c = [r for r in c if r["Index"] == field["occ"]]
    score = lambda r: 8 * (field["page"] is not None and r["Page"] == field["page"]) + 6 * (field["section_norm"] != "" and r["section_norm"] == field["section_norm"]) + 3 * (r["Index"] == field["occ"])
    return max(sorted(c, key=lambda r: r["row_no"]), key=score)["row_no"] if c else None


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("page, section", [(False, False), (True, False), (False, True), (True, True)])
def test_resolver_is_the_loop(spark, strict, page, section):
    rng = random.Random(3)
    sheet = [dict(row_no=i, field_norm=f"f{rng.randrange(5)}", section_norm=rng.choice(["", "a", "b"]), Page=rng.choice([None, 1, 2]), Index=rng.choice([None, 1, 2]), Value=f"v{i}") for i in range(40)]
    fields = [dict(field_no=i, label_norm=f"f{rng.randrange(6)}", page=rng.choice([None, 1, 2]), section_norm=rng.choice(["", "a", "b"]), occ=rng.choice([1, 2])) for i in range(120)]
    f = spark.createDataFrame(fields, "field_no long, label_norm string, page long, section_norm string, occ long")
    s = spark.createDataFrame(sheet, "row_no long, field_norm string, section_norm string, Page long, Index long, Value string")
    got = {r["field_no"]: r["row_no"] for r in R.resolve(f, s, strict, page, section).collect()}
    for x in fields:
        assert got.get(x["field_no"]) == loop_resolve(x, sheet, strict, page, section)


def test_fuzzy_takes_the_first_best(spark):
    f = spark.createDataFrame([(1, "adress line", None, "", 1), (2, "zzz", None, "", 1)], "field_no long, label_norm string, page long, section_norm string, occ long")
    s = spark.createDataFrame([(1, "address line", "", None, None, "A"), (2, "other", "", None, None, "B")], "row_no long, field_norm string, section_norm string, Page long, Index long, Value string")
    assert [(r["field_no"], r["value"], r["rule"]) for r in R.resolve(f, s, fuzzy=R.SIMILAR).collect()] == [(1, "A", "fuzzy")]


def test_greedy_and_merge_are_the_loops(spark):
    rng = random.Random(9)
    boxes = [(1 + i % 2, 1, i, float(rng.randrange(60)), float(rng.randrange(60)), rng.randrange(3)) for i in range(120)]
    df = spark.createDataFrame([(d, p, i, x, y, x + 12, y + 12, q) for d, p, i, x, y, q in boxes], "doc_id long, page long, box_no long, x0 double, y0 double, x1 double, y1 double, priority int")
    kept = []
    for b in sorted(boxes, key=lambda b: (b[5], b[4], b[3], b[2])):
        # boxes that touch, each 1.6 wider on all sides, overlap
        if not any(b[0] == k[0] and abs(b[3] - k[3]) <= 15.2 and abs(b[4] - k[4]) <= 15.2 for k in kept):
            kept.append(b)
    assert {r["box_no"] for r in C.greedy_boxes(df).collect()} == {b[2] for b in kept}
    touching = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0), (1, 1, 2, 13.2, 0.0, 20.0, 10.0, 0), (1, 1, 3, 23.3, 0.0, 30.0, 10.0, 0)], df.schema)
    assert {r["box_no"] for r in C.greedy_boxes(touching).collect()} == {1, 3}
    lines = [(1, 1, rng.randrange(40) / 10, rng.randrange(30) / 4, rng.randrange(30) / 4 + 80) for _ in range(300)]
    last, want = None, []
    for x in sorted(lines, key=lambda x: (round(x[2], 1), round(x[3], 1), x[2], x[3], x[4])):
        if last is None or not (abs(x[2] - last[2]) < 0.8 and abs(x[3] - last[3]) < 2 and abs(x[4] - last[4]) < 2):
            want.append(x)
            last = x
    found = C.merge_near(spark.createDataFrame(lines, "doc_id long, page long, y0 double, x0 double, x1 double"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and 1 < len(want) < 300


def test_boxes_are_written_once_a_place(spark):
    near = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 20.0), (2, 2, 10.3, 10.0, 20.0, 20.3), (3, 3, 13.1, 10.0, 20.0, 20.0), (4, 1, 50.0, 50.0, 60.0, 60.0)], "field_no long, label long, x0 double, y0 double, x1 double, y1 double")
    rows = near.selectExpr("1L AS doc_id", "CAST(NULL AS BIGINT) AS page", "*", "true AS is_checkbox", "'yes' AS value")
    got = O.write_once_boxes(rows, ["doc_id", "page"], ["page", "label"], "field_no").collect()
    assert sorted(r["field_no"] for r in got) == [1, 3]  # 2 is at the place of 1, 4 has the label of 1


def test_nearest_label_rules(spark):
    blocks = spark.createDataFrame([(1, 1, 1, " ", 80.0, 98.0, 100.0, 110.0), (1, 1, 2, "far", 10.0, 40.0, 100.0, 110.0), (1, 1, 3, "wide", 0.0, 300.0, 60.0, 80.0), (1, 1, 4, "near", 0.0, 180.0, 60.0, 80.0), (1, 1, 5, "right", 203.0, 300.0, 70.0, 85.0)], "doc_id long, page long, block_no long, text string, x0 double, x1 double, y0 double, y1 double")
    slots = spark.createDataFrame([(1, 1, 10, 100.0, 105.0), (1, 1, 11, 200.0, 100.0 - 5), (1, 1, 12, 200.0, 400.0)], "doc_id long, page long, field_no long, x0 double, y double")
    got = {r["field_no"]: (r["label"], r["how"]) for r in X.nearest_label(slots, blocks).collect()}
    # a blank block is no label; on the row wins over above; nothing near gives nothing
    assert got[10] == ("far", "row") and got[12] == (None, None)
    above = X.nearest_label(slots.filter("field_no = 11"), blocks.filter("block_no >= 3")).first()
    assert (above["label"], above["how"]) == ("wide", "above")  # of equally high ones the smallest gap; none begins right of the slot


def test_context_options_are_the_loop(spark):
    rng = random.Random(5)
    made = ["Please tick one:", "(a) first OR second", "- red", "• blue OR green", "plain words", "", "long " * 41, "- red", "(ii) third (tick here)", "x. y. z."]
    lines = [(d, n, rng.choice(made)) for d in range(12) for n in range(30)]
    strip = lambda t: " ".join(t.split())

    def parts(t):
        m = re.match(r"^\s*(?:\((?:[a-eA-E]|i{1,3}|iv|v)\)|[-–•])\s+(.*)$", t)
        body = re.sub(r"\s*\(tick[^)]*\)\s*$", "", m[1].strip()).strip() if m else t
        return [p.strip() for p in re.split(r"\s+\bOR\b\s+", body) if p.strip() and len(p.strip()) <= 140 and p.count(".") < 2 and len(p.split()) <= 24]

    want = []
    for d in range(12):
        texts = [strip(t) for e, _, t in lines if e == d]
        for i, t in enumerate(texts):
            if "please tick one" not in t.lower():
                continue
            opts, j = [], i + 1
            while j < len(texts) and len(opts) < 6:
                opts += [(j, p) for p in parts(texts[j])] if texts[j] else []
                if len(texts[j]) > 200 and opts:
                    break
                j += 1
            seen, uniq = set(), []
            for j, p in opts:
                k = re.sub(r"[!-/:-@\[-`{-~]", "", p.lower())
                if k and k not in seen:
                    seen.add(k)
                    uniq.append((d, i, j, p))
            want += uniq[:6] if len(uniq) >= 2 else []
    got = P.context_options(spark.createDataFrame(lines, "doc_id long, line_no long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_section_asof_ties(spark):
    marks = spark.createDataFrame([(1, 1, 10.0, "A"), (1, 1, 10.0, "B"), (1, 1, 50.0, "C")], "doc_id long, page long, y1 double, name string")
    fields = spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, 10.0, 2), (1, 1, 49.0, 3), (1, 1, 60.0, 4), (1, 2, 60.0, 5)], "doc_id long, page long, y double, field_no long")
    assert {r["field_no"]: r["section"] for r in X.section_asof(fields, marks).collect()} == {1: None, 2: "B", 3: "B", 4: "C", 5: None}


def test_gap_of_exactly_the_limit_joins(spark):
    s = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, "a"), (1, 1, 1, 45.0, 50.0, "b"), (1, 1, 1, 86.0, 90.0, "c")], "doc_id long, page long, line_no long, x0 double, x1 double, text string")
    assert sorted(r["text"] for r in X.clusters(s).collect()) == ["a b", "c"]


def test_placeholders_and_options(spark):
    texts = spark.createDataFrame([(1, "{{Name}} ${name} [[x]]")], "id long, text string")
    values = spark.createDataFrame([("name", "Ann")], "field_norm string, value string")
    assert P.fill_placeholders(texts, values).first()["text"] == "Ann Ann [[x]]"
    assert one(spark, P.inline_options("t"), t="Yes please; No thanks; yes please") == ["Yes please", "No thanks"]
    assert one(spark, P.inline_options("t"), t="only one part") == []
    assert one(spark, P.compound_options("t"), t="Bank State Branch") == []
    assert one(spark, P.compound_options("t"), t="Bank State Branch Office USA") == ["Bank State", "Branch Office USA"]


def test_lookup_sheet_round_trip(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_bytes("Section,Page,Field,Index,Value,Choices\nA,1.0,Café:,#2,x,\n,,Name,,nan,\n".encode("cp1252"))
    rows = sources.load(spark, str(path)).collect()
    assert [(r["Section"], r["Page"], r["Field"], r["Index"], r["Value"]) for r in rows] == [("A", 1, "Café:", 2, "x")]
    assert sources.load(spark, str(tmp_path / "none.csv"), lenient=True).count() == 0
    with pytest.raises(Exception):
        sources.load(spark, str(tmp_path / "none.csv"))
    simple = tmp_path / "simple.csv"
    simple.write_text("Name,City\nAnn,Rome\nBob,Oslo\n")
    assert {(r["Field"], r["Value"]) for r in sources.load(spark, str(simple), row=1).collect()} == {("Name", "Bob"), ("City", "Oslo")}
    sources.write_csv(spark.createDataFrame([("a", "b")], "Section string, Field string"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part*")).read_bytes().startswith(b"\xef\xbb\xbf")
    with pytest.raises(ValueError):
        L.require(spark.range(1))


def test_template_and_documents(spark, tmp_path):
    import json
    import zipfile

    (tmp_path / "t.json").write_text(json.dumps({"pdf": "x", "fields": [{"page": 1, "label": "Name", "choices": ["a"]}, {"page": "", "label": "Date"}]}))
    rows = sources.read_template(spark, str(tmp_path / "t.json")).orderBy("emit_no").collect()
    assert [(r["label"], r["page"]) for r in rows] == [("Name", 1), ("Date", None)]
    (tmp_path / "empty.json").write_text("[]")
    assert sources.read_template(spark, str(tmp_path / "empty.json")).count() == 0
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Name: ____</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    got = docx.read_docx(spark, str(tmp_path)).orderBy("block_no").collect()
    assert [(r["kind"], r["text"], r["table_no"]) for r in got] == [("para", "Name: ____", None), ("cell", "A", 0)]


def test_workbook_round_trip(spark, tmp_path):
    sheet = spark.createDataFrame([("A", "Name & Co", "x", "Yes | No"), ("B", "<b>", None, "")], "Section string, Field string, Value string, Choices string")
    data = sources.xlsx_bytes(sheet)
    (tmp_path / "s.xlsx").write_bytes(data)
    got = sources.read_table(spark, str(tmp_path / "s.xlsx")).orderBy("row_no").collect()
    assert [(r["Section"], r["Field"], r["Value"], r["Choices"]) for r in got] == [("A", "Name & Co", "x", "Yes | No"), ("B", "<b>", None, None)]
    import io
    import zipfile

    assert b'"Yes,No"' in zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml")


def test_document_fields(spark):
    blocks = spark.createDataFrame([(1, 1, "para", "WIRE DETAILS:"), (1, 2, "para", "Bank: _____"), (1, 3, "para", "Account name"), (1, 4, "para", "____"), (1, 5, "para", "[ ] I agree")], "doc_id long, block_no long, kind string, text string")
    cells = spark.createDataFrame([(1, 0, 0, 0, "City"), (1, 0, 0, 1, "")], "doc_id long, table_no long, row_no long, col_no long, text string")
    got = [(r["section"], r["label"], r["placement"]) for r in D.docx_fields(blocks, cells).orderBy("emit_no").collect()]
    assert ("WIRE DETAILS", "Bank", "docx_underline_inline") in got
    assert ("WIRE DETAILS", "Account name", "docx_underline_nextline") in got
    assert ("", "City", "docx_table_pair") in got


def test_document_placements(spark):
    blocks = [(1, 1, "Name of bank ______ Branch ......"), (1, 2, "Account holder    ____"), (1, 3, "Ref: ____"), (1, 4, "SECTION TWO:"), (1, 5, "City"), (1, 6, "_____")]
    cells = [(0, 0, 0, "Contact 1"), (0, 0, 1, "Contact 2"), (0, 1, 0, "Email: ____"), (0, 1, 1, "Phone\n____")]
    cells += [(1, 0, 0, ""), (1, 0, 1, "Trade"), (1, 0, 2, "Settle"), (1, 1, 0, "Fund A"), (1, 1, 1, ""), (1, 1, 2, ""), (1, 2, 0, "Notes"), (1, 2, 1, "see above"), (1, 2, 2, "")]
    cells += [(2, 0, 0, "Country"), (2, 0, 1, "____")]
    b = spark.createDataFrame([(d, n, "para", t) for d, n, t in blocks], "doc_id long, block_no long, kind string, text string")
    c = spark.createDataFrame([(1, *x) for x in cells], "doc_id long, table_no long, row_no long, col_no long, text string")
    got = [(r["placement"].removeprefix("docx_"), r["section"], r["label"], r["index"]) for r in D.docx_fields(b, c).orderBy("emit_no").collect()]
    assert got[:3] == [("underline_inline_spacey", "", "Name of bank", 1), ("underline_inline_spacey", "", "Branch", 1), ("underline_inline_spacey", "", "Account holder", 1)]
    assert got[3:5] == [("underline_inline", "", "Ref", 1), ("underline_nextline", "SECTION TWO", "City", 1)]
    assert ("table_samecell", "Contact 1", "Email", 1) in got and ("table_samecell", "Contact 2", "Phone", 2) in got
    assert ("table_grid_row", "Fund A", "Trade", 1) in got and ("table_grid_row", "Fund A", "Settle", 1) in got and ("table_pair_row", "Notes", "Notes", 1) in got
    assert got[-1] == ("table_pair", "", "Country", 1) and len(got) == 11


def test_document_plan(spark):
    b = spark.createDataFrame([(1, 1, "para", "Dear {{ Name }},"), (1, 2, "para", "Ref: ____ end"), (1, 3, "para", "[ ] I agree"), (1, 4, "para", "Town"), (1, 5, "para", "_____"), (1, 6, "para", "Street: main"), (2, 1, "para", "Nothing here")], "doc_id long, block_no long, kind string, text string")
    c = spark.createDataFrame([(1, 0, 0, 0, "Country"), (1, 0, 0, 1, "____")], "doc_id long, table_no long, row_no long, col_no long, text string")
    rows = [("Name", "Ann"), ("Ref", "R1"), ("I agree", "yes"), ("Town", "Rome"), ("Street", "High St"), ("Country", "IT")]
    sheet = spark.createDataFrame([(n, f, f.lower(), "", None, None, v) for n, (f, v) in enumerate(rows)], "row_no long, Field string, field_norm string, section_norm string, Page long, Index long, Value string")
    got = {(r["doc_id"], r["place"], r["col"]): (r["pass"], r["text"]) for r in passes.document_plan(b, c, sheet).collect()}
    assert got == {
        (1, 1, 0): ("placeholders", "Dear Ann,"), (1, 2, 0): ("underlines", "Ref: R1 end"), (1, 3, 0): ("checkboxes", "☑ I agree"), (1, 5, 0): ("underlines", "Rome"),
        (1, 6, 0): ("last_chance", "Street: main High St"), (1, 1000000, 1): ("tables", "IT"),
    }


def test_section_marks_by_shape(spark):
    lines = [(1, 1, 1, "Wire Details (optional)", 10.0, 90.0, 10.0, 9.0), (1, 1, 2, "some plain words of a line", 0.0, 50.0, 30.0, 9.0), (1, 1, 3, "wide words all over the page", 0.0, 400.0, 50.0, 9.0), (1, 1, 4, "Page 3 Of Four", 0.0, 400.0, 70.0, 9.0)]
    df = spark.createDataFrame(lines, "doc_id long, page long, line_no long, text string, x0 double, x1 double, y_mid double, max_size double")
    none = spark.createDataFrame([], "doc_id long, page long, p80 double")
    got = {r["name_norm"] for r in X.section_marks(df, large=none, width=600.0).collect()}
    assert got == {"wire details", "wide words all over the page"}


def test_files_by_what_they_are(spark, tmp_path):
    sheet = spark.createDataFrame([("Name", "Ann")], "Field string, Value string")
    path = sources.write_sheet(sheet, str(tmp_path / "book.xlsx"))
    renamed = tmp_path / "old.xls"
    renamed.write_bytes((tmp_path / "book.xlsx").read_bytes())
    assert path.endswith("book.xlsx") and sources.read_form(spark, str(renamed)).first()["Value"] == "Ann"
    (tmp_path / "text.xls").write_text("Field,Value\nName,Bob\n")
    assert sources.read_form(spark, str(tmp_path / "text.xls"), lenient=True, unknown=1).first()["Value"] == "Bob"
    (tmp_path / "binary.xls").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1"))
    for bad in ("binary.xls", "form.pdf"):
        with pytest.raises(ValueError):
            sources.read_form(spark, str(tmp_path / bad))

    def fails(df):
        raise ValueError("too many rows for a worksheet")

    assert sources.write_sheet(sheet, str(tmp_path / "big.xlsx"), fails).endswith("big.csv") and (tmp_path / "big.csv").exists()
    assert sources.read_form(spark, "any.pdf", {".pdf": lambda s, path: path}) == "any.pdf"


def test_small_helpers(spark):
    one = spark.range(1)
    fused = lambda t: one.select(P.fused_options(F.lit(t)).alias("x")).first()["x"]
    assert fused("Account statements Annual (audited)/quarterly (unaudited) financial statements") == ["Account statements", "Annual (audited)/quarterly (unaudited) financial statements"]
    assert fused("Net asset value Capital (call) notices") == ["Net asset value", "Capital (call) notices"] and fused("Value Capital (call)") == ["Value Capital (call)"]
    assert one.select(T.positive_page(F.lit(0), 0).alias("p"), T.positive_page(F.lit(-1)).alias("q")).first()[:] == (0, None)
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 12.0), (1, 1, 0.0, 0.0, 10.0, 20.0), (1, 1, 5.0, 0.0, 10.0, 5.0)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    assert [r["x1"] for r in D.small_boxes(rects).collect()] == [10.0]
    visits = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4)], "page long, section string, emit_no long")
    assert {r["page"]: r["sections"] for r in L.sections_by_page(visits).collect()} == {1: ["b", "a"], 2: ["a"]}


def test_labelled_fields_feed_the_plan(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, "Full name", 10.0, 60.0, 100.0, 110.0), (1, 1, 1, 2, "______", 70.0, 200.0, 100.0, 110.0), (1, 1, 2, 1, "Tick here", 40.0, 90.0, 140.0, 150.0)], "doc_id long, page long, line_no long, span_no long, text string, x0 double, x1 double, y0 double, y1 double").withColumn("size", F.lit(9.0))
    blocks = words.filter("span_no = 1").withColumn("block_no", F.col("line_no"))
    boxes = spark.createDataFrame([(1, 1, 1, 20.0, 139.0, 30.0, 149.0, "rect")], "doc_id long, page long, box_no long, x0 double, y0 double, x1 double, y1 double, source string")
    lines = X.line_envelopes(words.filter("span_no = 1"))
    sections = spark.createDataFrame([(1, 1, 50.0, "Client (new)")], "doc_id long, page long, y1 double, name string")
    found = D.label_fields(D.discover([D.underscores(words), D.checkboxes(boxes)]), blocks, lines, words, sections)
    got = [(r["placement"], r["label"], r["label_short"], r["section"], r["index"]) for r in found.orderBy("emit_no").collect()]
    assert got == [("start", "Full name", "Full name", "Client (new)", 1), ("checkbox", "Client – item 1: Tick here", "Client – item 1", "Client (new)", 1)]
    sheet = spark.createDataFrame([(1, "Client", "Full Name", "Ann"), (2, "Client", "Client – item 1", "yes")], "row_no long, Section string, Field string, Value string")
    plan = {r["label"]: r["value"] for r in fill_plan.fill_plan(sheet, found.withColumn("field_no", F.col("emit_no"))).collect()}
    assert plan["full name"] == "Ann" and "yes" in plan.values()


def loop_value(rows, label, page, section, occ, strict, need_page, need_section):
    """One field against the sheet, rule by rule."""
    cand = [r for r in rows if r["f"] == label]
    if section:
        hit = [r for r in cand if r["s"] == section]
        cand = hit if hit or need_section else cand
    if page is not None:
        hit = [r for r in cand if r["p"] == page]
        cand = hit if hit or need_page else cand
    if strict and any(r["i"] is not None for r in cand):
        cand = [r for r in cand if r["i"] == occ]
    score = lambda r: 8 * (page is not None and r["p"] == page) + 6 * bool(section and r["s"] == section) + 3 * (r["i"] == occ)
    return max(cand, key=score, default=None)


def loop_plan(rows, fields):
    """The fill plan as a loop over the fields in order."""
    used, counts, written, ticked, out = collections.defaultdict(set), collections.Counter(), set(), set(), {}
    for x in sorted(fields, key=lambda x: x["emit_no"]):
        tail = [x["label"].split(":")[0]] if ":" in x["label"] else []
        box = x["placement"] == "checkbox"
        keys = [x["label_short"]] if box and x["label_short"] else [k for k in (x["label_short"], *tail, x["label"]) if k]
        keys = [" ".join(re.sub(r"[^a-z0-9 ]", "", k.lower()).split()) for k in keys]
        key = next((k for k in keys if any(r["f"] == k for r in rows)), None)
        if key is None:
            out[x["field_no"]] = (None, None, "no match")
            continue
        row = loop_value(rows, key, x["page"], x["section"], 1, False, False, False)
        section = row["s"] or x["section"]
        bucket = (x["doc_id"], x["page"], section, key)
        free = sorted({r["i"] for r in rows if r["f"] == key and r["i"] is not None and (x["page"] is None or r["p"] == x["page"]) and (not section or r["s"] == section)} - used[bucket])
        if free:
            idx = free[0]
        else:
            counts[bucket] += 1
            idx = counts[bucket]
        used[bucket].add(idx)
        if row["p"] is not None and row["s"]:
            tries = [(True, True), (False, True), (True, False)]
        elif row["s"]:
            tries = [(False, True), (True, False)]
        else:
            tries = [(True, False), (False, True)]
        value = next((r["v"] for r in (loop_value(rows, key, x["page"], section, idx, True, *t) for t in tries) if r), None)
        place = (x["doc_id"], x["page"], *(round(x[c] / 2) for c in ("x0", "y0", "x1", "y1")))
        why = "no value" if value is None else "unclear" if box and value not in ("yes", "no") else "other answer" if box and x["token"] in ("yes", "no") and x["token"] != value else None
        if why is None and ((*bucket, idx) in written or (box and place in ticked)):
            why = "written before"
        if why is None:
            written.add((*bucket, idx))
            ticked |= {place} if box else set()
        out[x["field_no"]] = (idx, None if why else value, why or "written")
    return out


def test_fill_plan_is_the_loop(spark):
    rng = random.Random(21)
    pick = lambda *x: rng.choice(x)
    sheet = [(i, pick("", "A", "B (old)"), pick("", "1", "2.0", "n/a"), f"Field {rng.randrange(6)}{pick('', ':', ' (x)')}", pick("", "#1", "2", "3"), pick("yes", "no", f"v{i}", f"v{i}", "", "nan")) for i in range(70)]
    number = lambda t: int(float(t)) if t and t != "n/a" else None
    rows = [dict(f=f"field {f[6]}", s={"": "", "A": "a", "B (old)": "b"}[s], p=number(p), i=int(i.strip("#")) if i else None, v=v) for _, s, p, f, i, v in sheet if v not in ("", "nan")]
    fields = []
    for n in range(400):
        x, y = rng.randrange(12) / 2, rng.randrange(12) / 2
        fields.append(dict(field_no=1000 - n, emit_no=n, doc_id=n % 3, page=pick(None, 1, 2), section=pick("", "a", "b"), label=pick(f"Field {rng.randrange(8)}", f"Field {rng.randrange(8)}: amount", "other"), label_short=pick("", "", f"Field {rng.randrange(8)}"), placement=pick("", "checkbox"), token=pick(None, None, "yes", "no"), x0=x, y0=y, x1=x + 8, y1=y + 8))
    schema = "field_no long, emit_no long, doc_id long, page long, section string, label string, label_short string, placement string, token string, x0 double, y0 double, x1 double, y1 double"
    plan = fill_plan.fill_plan(spark.createDataFrame(sheet, "row_no long, Section string, Page string, Field string, Index string, Value string"), spark.createDataFrame([tuple(x.values()) for x in fields], schema), None)
    got = {r["field_no"]: (r["idx"], r["value"], "written" if r["value"] else r["rule"]) for r in plan.collect()}
    want = loop_plan(rows, fields)
    assert got == want and {w[2] for w in want.values()} == {"no match", "no value", "unclear", "other answer", "written before", "written"}


def test_fill_plan(spark, tmp_path):
    sheet = spark.createDataFrame([(1, "A", "", "Name:", "2", "second"), (2, "A", "", "Name", "1", "first"), (3, "A", "", "Name", "1", "again"), (4, "", "", "Age", "", "44")], "row_no long, Section string, Page string, Field string, Index string, Value string")
    fields = spark.createDataFrame([(10, "a", "Name"), (11, "a", "NAME:"), (12, "a", "Name"), (13, "b", "Age"), (14, "b", "unknown_3"), (15, "b", "Nmae")], "field_no long, section string, label string")
    plan = fill_plan.fill_plan(sheet, fields)
    got = {r["field_no"]: (r["idx"], r["value"], r["rule"]) for r in plan.collect()}
    assert got[10] == (1, "first", "exact section") and got[11] == (2, "second", "exact section")
    assert got[12] == (1, None, "written before")  # the sheet's two names are taken
    assert got[13] == (1, "44", "exact label")  # a blank section in the sheet constrains nothing
    assert got[14] == (None, None, "no label") and got[15][2] in ("no match", "written before", "no value", "similar section")
    dry = {r["field_no"]: r["action"] for r in fill_plan.report(plan, fields).collect()}
    assert dry[10] == "write first" and dry[12] == "written before" and len(dry) == 6
    path = tmp_path / "sheet.csv"
    path.write_text("Section,Field,Value\nA,Name,Ann\n")
    from formweave.sources.lookup import load

    # a row without an index answers every visit, each with an index of its own
    assert sorted(r["idx"] for r in fill_plan.fill_plan(load(spark, str(path)), fields).filter("value = 'Ann'").collect()) == [1, 2, 3]
    empty = fill_plan.fill_plan(sheet.limit(0), fields)
    assert {r["rule"] for r in empty.collect()} == {"no match", "no label"} and fill_plan.fill_plan(sheet, fields.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "A", "Name", 1), (2, "A", "Age", 1)], "field_no long, section string, label string, idx long").write.parquet(str(tmp_path / "in"))
    lookup = spark.createDataFrame([(1, "a", "name", 1, "Ann")], "row_no long, section_norm string, field_norm string, Index long, Value string")
    stream = spark.readStream.schema("field_no long, section string, label string, idx long").parquet(str(tmp_path / "in"))
    q = streaming.resolve_stream(stream, lookup).writeStream.format("memory").queryName("filled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["field_no"], r["value"]) for r in spark.table("filled").collect()} == {(1, "Ann"), (2, None)}
    counts = spark.createDataFrame([("a", 2)], "k string, n long")
    rows, counts = streaming.number_batch(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "emit_no long, k string"), counts, ["k"])
    assert {(r["emit_no"], r["idx"]) for r in rows.collect()} == {(1, 3), (2, 1), (3, 4)}
    assert {(r["k"], r["n"]) for r in counts.collect()} == {("a", 4), ("b", 1)}


def _lists(spark, labels, names):
    want = spark.createDataFrame([(x,) for x in labels], "label_norm string")
    sheet = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "row_no long, field_norm string")
    return want, sheet


def _first_best(label, names, score, threshold):
    found = [(score(label, n), -i, n) for i, n in enumerate(names)]
    best = max(found)
    return best[2] if best[0] >= threshold else None


def test_token_best_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    words = ["account", "acount", "field", "feild", "name", "bank", "address", "adress", "of", "1", "12", "21", "345"]
    draw = lambda n: sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)}, key=lambda x: rng.random())
    labels, names = draw(120) + ["adres", "zzz"], draw(90)
    names = [n for n in names if len(n.split()) > 1]
    got = {r["label_norm"]: r["matched"] for r in R._token_best(*_lists(spark, labels, names)).collect()}
    want = {x: _first_best(x, names, S.token_set_score, R.TOKEN_SIMILAR) for x in labels}
    assert got == {k: v for k, v in want.items() if v is not None}
    # no word in common
    assert R._token_best(*_lists(spark, ["addresses"], ["address", "adresses"])).collect()[0]["matched"] == "adresses"


def test_best_labels_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    draw = lambda n: sorted({"".join(rng.choices("ab cd", k=rng.randint(4, 9))).strip() or "x" for _ in range(n)})
    labels, names = draw(150), draw(60)
    fields, sheet = _lists(spark, labels, names)
    got = {r["label_norm"]: r["matched"] for r in R.best_labels(fields, sheet, 0.7).collect()}
    want = {x: _first_best(x, names, S.sequence_ratio, 0.7) for x in labels if x not in names}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_structured_query_takes_similar_labels(spark):
    from formweave.plans import resolving
    from formweave.plans.base import given

    d = "/root/testdata/sf0.001"
    got = {r["field_no"]: (r["value"], r["rule"]) for r in resolving.resolve_structured_similar(spark, d).collect()}
    keys = {r["field_no"]: r["value"] for r in resolving.resolve_structured(spark, d).collect()}
    rows = sorted((r["row_no"], r["field_norm"], r["Value"]) for r in given(spark, d, "sheet").collect())
    names = list(dict.fromkeys(n for _, n, _ in rows))
    want = {k: (v, "key") for k, v in keys.items()}
    for f in given(spark, d, "fields").collect():
        if f["field_no"] not in keys:
            hit = _first_best(f["label_norm"], names, S.token_set_score, R.TOKEN_SIMILAR)
            values = [v for _, n, v in rows if n == hit and v]
            if values:
                want[f["field_no"]] = (values[0], "similar")
    assert got == want and len(got) > len(keys)


def test_column_header_is_the_loop(spark):
    rng = random.Random(11)
    spans = [(1, 1, n, float(rng.randrange(0, 400, 10)), float(n * 20), float(n * 20 + 10), f"t{n}.{i}") for n in range(12) for i in range(rng.randrange(1, 5))]
    spans = [(d, p, n, x, x + 30, y0, y1, t) for d, p, n, x, y0, y1, t in spans] + [(1, 1, 50, 0.0, 10.0, 228.0, 239.0, " ")]
    slots = [(1, 1, i, float(x), float(x + 40), float(y)) for i, (x, y) in enumerate((rng.randrange(400), rng.randrange(300)) for _ in range(80))]
    want = {}
    for _, _, i, a, b, y in slots:
        lines = {n: [s for s in spans if s[2] == n and s[7].strip()] for n in {s[2] for s in spans}}
        near = [(y - max(s[6] for s in ss), n) for n, ss in lines.items() if ss and 0 < y - max(s[6] for s in ss) <= 48]
        want[i] = ""
        if near:
            groups, last = [], None
            for s in sorted(lines[min(near)[1]], key=lambda s: (s[3], s[5], s[4], s[7])):
                if last is None or s[3] - last > 35:
                    groups.append([])
                groups[-1].append(s)
                last = s[4]
            cols = [(min(s[3] for s in g), max(s[4] for s in g), " ".join(s[7] for s in g)) for g in groups]
            if len(cols) >= 2:
                over = [max(0.0, min(b, c[1]) - max(a, c[0])) for c in cols]
                best = max(range(len(cols)), key=lambda k: (over[k], 0 if over[k] else -abs((a + b) / 2 - (cols[k][0] + cols[k][1]) / 2), -cols[k][0]))
                want[i] = cols[best][2]
    got = X.column_header(spark.createDataFrame(slots, "doc_id long, page long, field_no long, x0 double, x1 double, y double"), spark.createDataFrame(spans, "doc_id long, page long, line_no long, x0 double, x1 double, y0 double, y1 double, text string"))
    assert {r["field_no"]: r["header"] for r in got.collect()} == want and "" in want.values() and len(set(want.values())) > 5


def test_discover_query_has_every_pass(spark):
    from formweave.plans import placing

    found = {r["found_by"] for r in placing.discover_pdf(spark, "/root/testdata/sf0.001").select("found_by").distinct().collect()}
    assert found >= {"typed", "underline", "dropdown", "shallow box", "block gap", "checkbox", "box widget", "choice widget", "text widget"}


def test_slots_are_in_few_bands(spark):
    from formweave.operators import spatial as X

    slots = spark.range(200).selectExpr("0L AS doc_id", "0L AS page", "id AS field_no", "id * 3.5D AS y")
    none = spark.createDataFrame([], "doc_id long, page long, by double")
    assert X._banded(slots, none, "y", "by", 36.0, how="left").count() <= 350
    assert X._banded(slots, none, "y", "by", 36.0, how="left", below=0).count() <= 300


def test_matrices_against_a_loop(spark):
    rng = random.Random(3)
    texts = {"head": ["Name", "Town"], "one": ["Name", ""], "blank": ["", "___"], "long": ["x" * 150, "Name 1"]}
    rows = [(1, t, n, rng.choice(["head", "one", "blank", "blank", "blank", "long"])) for t in range(40) for n in range(12) if rng.random() < 0.9]
    want = set()
    for t in range(40):
        kinds = {n: k for _, u, n, k in rows if u == t}
        busy = -1
        for n in sorted(kinds):
            below = n + 1
            while kinds.get(below) == "blank":
                below += 1
            if n > busy and kinds[n] == "head" and below > n + 1:
                want.add((1, t, n, below - n - 1))
                busy = below - 1
    cells = spark.createDataFrame([(d, t, n, c, x) for d, t, n, k in rows for c, x in enumerate(texts[k])], "doc_id long, table_no long, row_no long, col_no long, text string")
    found = C.matrices(cells)
    assert want and {tuple(r) for r in found.collect()} == want
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_kept_in_order_are_numbered(spark):
    """Kept rows are numbered through all pages of a document, over batches too."""
    rows = spark.createDataFrame([(d, p, x) for d in (1, 2) for p in (2, 1) for x in range(5)], "doc_id long, page long, x long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = C.keep_in_order(rows, ("doc_id", "page"), ["x"], ["x"], dict, lambda state, row: row[0] % 2 == 0, "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(p, x) for p in (1, 2) for x in (0, 2, 4)]
    assert sorted(map(tuple, found)) == sorted((d, p, x, n) for d in (1, 2) for n, (p, x) in enumerate(want, 1))


def test_shallow_boxes_give_way_by_rounded_corners(spark):
    """Corners count to a tenth, halves away from zero, and -0.0 is 0.0; equal shallow boxes
    don't take each other.  One width for all pages is as good as a table of them."""
    field = lambda page, x0, y0, by: (1, page, x0, x0 + 100.0, y0, y0 + 20.0, y0 + 10.0, "acro_choice", None, None, by)
    rows = [field(1, -0.0, 0.25, "dropdown"), field(1, 0.0, 0.3, "shallow box"), field(1, 0.0, 0.2, "shallow box"), field(1, 0.0, 0.2, "shallow box"), field(2, 0.0, 0.3, "shallow box")]
    kinds = "doc_id long, page long, x0 double, x1 double, y0 double, y1 double, mid double, placement string, label string, name string, found_by string"
    found = D.discover([spark.createDataFrame(rows, kinds)]).orderBy("emit_no").collect()
    assert [(r.page, r.y0, r.found_by, r.emit_no) for r in found] == [(1, 0.25, "dropdown", 1), (1, 0.2, "shallow box", 2), (1, 0.2, "shallow box", 3), (2, 0.3, "shallow box", 4)]
    words = spark.createDataFrame([(1, 0, 0, "Name:", 10.0, 40.0, 0.0, 10.0)], "doc_id long, page long, line_no long, text string, x0 double, x1 double, y0 double, y1 double")
    pages = spark.createDataFrame([(1, 0, 300.0)], "doc_id long, page long, width double")
    assert D.right_gaps(words, "line gap", 300.0).collect() == D.right_gaps(words, "line gap", pages).collect() != []
