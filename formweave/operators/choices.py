"""Ticking one of several options: groups in table rows, options on one line, boxes beside
sentences.

All give offers of new text for places of a document (target: doc_id, place, row, col), as
the passes take them.  Every different question to the sheet is asked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..sources.shared import cut, stored
from . import options as P
from . import resolve as R
from .folding import folded

# Marks of chosen and other options, glyphs of boxes, where options on a line
# part, how long they are and how many, and how similar an option is to the value it is.
CHOSEN, OTHER, GLYPH = "☒", "☐", r"\[\s*[xX✓]?\s*\]|[□☐☑☒]"
APART, WORDS, MANY, ALIKE = r"(?i)\t+|\s{2,}|\s+OR\s+", 4, 6, 80.0
LETTER = r"[A-Za-z]"
#: Place of a table among the places of a document.
TABLES = 1000000


def answers(asked: DataFrame, lookup: DataFrame) -> DataFrame:
    """label, occ and answer of each different question (label, occ), a label as it stands
    in the document; the document agent's resolver without regard to other indexes."""
    rows = cut(asked.select("label", F.col("occ").cast("long").alias("occ")).filter("label <> ''").distinct())
    keyed = folded(rows.withColumn("label_norm", F.col("label")), "label_norm")
    keyed = keyed.withColumns({"field_no": F.struct("label", "occ"), "label_norm": T.alias(T.normalize("label_norm")), "page": F.lit(None).cast("long"), "section_norm": F.lit("")})
    found = R.resolve(keyed, lookup, strict_index=False, fuzzy=R.SIMILAR, overlap=True, weights=R.AGENT_WEIGHTS)
    return _few(cut(found.select("field_no.label", "field_no.occ", F.col("value").alias("answer"))))


#: Rows of answers and scores that are broadcast; more of them are met by shuffles.
FEW = 1 << 15


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, which are stored, to be broadcast if a count finds them few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _answered(rows: DataFrame, found: DataFrame, label: str, name: str, occ: str = "occ") -> DataFrame:
    given = found.select(F.col("label").alias(label), F.col("occ").alias(occ), F.col("answer").alias(name))
    return rows.join(given, [label, occ], "left")


def _target(rows: DataFrame) -> Column:
    return F.struct(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "place", "row", "col")])


def option_groups(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows of two short labels or more over cells without letters: each label is asked for,
    and where the sheet does not say yes or no, whether it is the value of the group.

    A group is called by the nearest text left of its first label, else by its whole row; the
    nearest number left of it, in either row, is its index.  An option that is chosen is
    marked, any other of a group with an answer cleared.
    """
    at = ["doc_id", "table_no", "row_no"]
    text = T.trim_all("text")
    clean = T.strip_one_colon(text)
    short = (T.n_words(clean) <= WORDS) & clean.rlike(LETTER)
    below = cells.select("doc_id", "table_no", (F.col("row_no") - 1).alias("row_no"), "col_no", F.col("text").alias("below"))
    rows = cells.select(*at, "col_no", text.alias("text"), T.trim_all(clean).alias("label"), short.alias("short")).join(below, [*at, "col_no"], "left")
    w = Window.partitionBy(*at)
    open_ = F.col("below").isNotNull() & ~F.col("below").rlike(LETTER)
    rows = rows.withColumns({"n": F.count_if("short").over(w), "ok": F.every(~F.col("short") | open_).over(w), "first": F.min(F.when(F.col("short"), F.col("col_no"))).over(w)})
    rows = rows.filter("n >= 2 AND ok")
    left = F.col("col_no") < F.col("first")
    digits = F.nullif(F.regexp_extract(F.coalesce(F.nullif("text", F.lit("")), F.trim("below")), r"\b(\d+)\b", 1), F.lit(""))
    line = F.array_join(F.transform(F.array_sort("texts"), lambda x: x["text"]), " ")
    # over the window that is there, so that no row is dealt again
    rows = rows.withColumns({
        "idx": F.max(F.when(left & digits.isNotNull(), F.struct("col_no", digits.cast("long").alias("n")))).over(w)["n"],
        "beside": F.max(F.when(left & (F.col("label") != ""), F.struct("col_no", "label"))).over(w)["label"],
        "texts": F.collect_list(F.struct("col_no", "text")).over(w),
    })
    groups = rows.filter("short").withColumns({"occ": F.coalesce("idx", F.lit(1)).cast("long"), "group": F.coalesce("beside", T.strip_colons(line))})
    groups = stored(groups.select(*at, "col_no", "label", "group", "occ", "below"))
    found = answers(groups.select("label", "occ").unionByName(groups.select(F.col("group").alias("label"), "occ")), lookup)
    both = _answered(_answered(groups, found, "label", "own"), found, "group", "of_group")
    chosen = F.coalesce(T.truthy("own"), F.lower("label") == F.lower(F.nullif(T.trim_all("of_group"), F.lit(""))))
    mark = F.when(chosen, CHOSEN).otherwise(OTHER)
    new = F.when(F.col("below").contains(OTHER), F.concat(F.substring_index("below", OTHER, 1), mark, F.expr(f"substr(below, instr(below, '{OTHER}') + 1)"))).otherwise(mark)
    out = both.filter(chosen.isNotNull()).withColumns({"place": F.col("table_no") + TABLES, "row": F.col("row_no") + 1, "col": F.col("col_no"), "new": new})
    return out.select(_target(out).alias("target"), (F.col("row_no") * 1000 + F.col("col_no")).alias("emit_no"), F.col("new").alias("value"), "label", F.col("occ").alias("idx"))


def line_group(c) -> Column:
    """Options of a line: two to six short parts between wide gaps, tabs or OR, else the two
    labels that share it; none is an empty array."""
    t = T.trim_all(F.regexp_replace(T.trim_all(c), rf"^\s*(?:{GLYPH})\s*", ""))
    parts = F.filter(F.transform(F.split(t, APART), T.trim_all), lambda p: (p != "") & (T.n_words(p) <= WORDS))
    two = P.two_labels(c)
    some = F.size(parts).between(2, MANY) & (F.size(F.array_distinct(parts)) >= 2)
    return F.when(some, parts).when(F.size(two) >= 2, two).otherwise(F.array().cast("array<string>"))


def inline_groups(held: DataFrame, lookup: DataFrame) -> DataFrame:
    """Lines (doc_id, place, row, col, text) that list options: those that the sheet says yes
    to are marked, or if it says nothing about any, the one that is the value of the whole
    line; the others are cleared.  Lines that the sheet knows nothing of stay."""
    lines = held.withColumn("options", line_group("text")).filter("size(options) >= 2").withColumn("line", T.trim_all("text"))
    lines = cut(lines.select("doc_id", "place", "row", "col", "text", "line", "options", F.lit(1).cast("long").alias("occ")))
    found = answers(lines.select(F.explode("options").alias("label"), "occ").unionByName(lines.select(F.col("line").alias("label"), "occ")), lookup)
    at = ["doc_id", "place", "row", "col"]
    each = _answered(lines.select(*at, "occ", F.posexplode("options").alias("n", "label")), found, "label", "own")
    own = each.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("n", "label", T.truthy("own").alias("yes")))).alias("parts"))
    rows = _answered(lines.select(*at, "text", "line", "occ"), found, "line", "of_line").join(own, at)
    said = F.exists("parts", lambda p: p["yes"].isNotNull())
    named = F.exists("parts", lambda p: F.lower(T.collapse(p["label"])) == F.lower(T.collapse(F.col("of_line"))))
    yes = lambda p: F.when(said, F.coalesce(p["yes"], F.lit(False))).otherwise(F.lower(T.collapse(p["label"])) == F.lower(T.collapse(F.col("of_line"))))
    new = F.array_join(F.transform("parts", lambda p: F.concat(F.when(yes(p), CHOSEN).otherwise(OTHER), F.lit(" "), p["label"])), "  ")
    rows = rows.filter(said | F.coalesce(named, F.lit(False))).withColumn("new", new).filter("new <> text")
    return rows.select(_target(rows).alias("target"), F.col("place").alias("emit_no"), F.col("new").alias("value"), F.col("line").alias("label"), F.col("occ").alias("idx"))


def two_column_boxes(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Boxes in a cell beside one that says what is ticked: a glyph, else a short filler, else
    a cell without letters, the left cell of a pair before the right one.  The glyph is set
    by the answer; a cell without one becomes it."""
    across = Window.partitionBy("doc_id", "table_no", "row_no").orderBy("col_no")
    # what a cell looks like is found once, before it meets its neighbour
    looks = {"glyph": F.col("_t").rlike(GLYPH), "filler": F.col("_t").rlike(r"^[-_.—–·•\s]{1,6}$"), "empty": ~F.col("_t").rlike(LETTER), "says": T.is_checkbox_sentence(T.inline_norm("_t"))}
    rows = cells.select("doc_id", "table_no", "row_no", "col_no", "text", T.trim_all("text").alias("_t")).withColumns({f"_{k}": c for k, c in looks.items()})
    pairs = rows.withColumns({f"{c}_r": F.lead(c).over(across) for c in ("col_no", "text", "_t", *[f"_{k}" for k in looks])}).filter("col_no_r = col_no + 1").withColumnsRenamed({"text_r": "_right", "col_no_r": "_next"})
    a, b = F.col("_t"), F.col("_t_r")
    side = None
    for kind in ("glyph", "filler", "empty"):
        for box, sentence, name in (("", "_r", "left"), ("_r", "", "right")):
            hit = F.col(f"_{kind}{box}") & F.col(f"_says{sentence}")
            side = F.when(hit, name) if side is None else side.when(hit, name)
    left = F.col("side") == "left"
    rows = pairs.withColumn("side", side).filter("side IS NOT NULL").withColumns({
        "box": F.when(left, F.col("text")).otherwise(F.col("_right")), "label": T.inline_norm(T.strip_one_colon(F.when(left, b).otherwise(a))),
        "place": F.col("table_no") + TABLES, "row": F.col("row_no"), "col": F.when(left, F.col("col_no")).otherwise(F.col("_next")), "occ": F.lit(1).cast("long"),
    })
    rows = stored(rows.select("doc_id", "place", "row", "col", "col_no", "box", "label", "occ"))
    rows = _answered(rows, answers(rows, lookup), "label", "own").withColumn("yes", T.truthy("own")).filter("yes IS NOT NULL")
    token = F.regexp_extract("box", rf"({GLYPH})", 1)
    mark = F.when(token.startswith("["), F.when(F.col("yes"), "[x]").otherwise("[ ]")).otherwise(F.when(F.col("yes"), CHOSEN).otherwise(OTHER))
    at = F.locate("§", F.regexp_replace("box", rf"^((?s:.*?))(?:{GLYPH})", "$1§"))
    new = F.when(token != "", F.concat(F.substring("box", F.lit(1), at - 1), mark, F.substring("box", at + F.length(token), F.length("box")))).otherwise(mark)
    rows = rows.withColumn("new", new)
    return rows.select(_target(rows).alias("target"), (F.col("row") * 1000 + F.col("col_no")).alias("emit_no"), F.col("new").alias("value"), "label", F.col("occ").alias("idx"))


# Fixed value: a box and its option, up to a wide gap.
BOXED = r"[□☐]\s*[^\s].*?(?=\s{2,}|$)"


def tick_similar(lines: DataFrame, least: float = ALIKE) -> DataFrame:
    """``lines`` (text and value, and more) with the box ticked whose option is most like the
    value by its words, the first of equals, if it is ``least`` alike; other boxes are empty.
    Without such an option, boxes or a value the text stays.

    Boxes and options are met where they stand, and the line is put together again from what
    is between them, so equal options are told apart.
    """
    plain = F.regexp_replace("text", "[☑☒■]", "□")
    rows = lines.withColumn("_boxes", F.when(F.coalesce(T.trim_all("value"), F.lit("")) != "", F.regexp_extract_all(plain, F.lit(f"({BOXED})"), F.lit(1))))
    option = lambda m: T.trim_all(F.regexp_replace(m, r"^[□☐]\s*", ""))
    asked = rows.select(F.col("value").alias("_v"), F.explode(F.transform("_boxes", option)).alias("_o")).distinct()
    scored = cut(asked.select("_v", "_o", S.token_set_ratio("_v", "_o").alias("_s")).filter(F.col("_s") >= least))
    scores = _few(cut(scored.groupBy("_v").agg(F.map_from_entries(F.collect_list(F.struct("_o", "_s"))).alias("_scores"))))
    met = rows.join(scores, rows["value"] == scores["_v"], "left")
    ranked = F.transform("_boxes", lambda m, i: F.struct(F.coalesce(F.col("_scores")[option(m)], F.lit(-1.0)).alias("s"), (-i).alias("i")))
    best = F.array_max(ranked)
    gaps = F.split(plain, BOXED, -1)
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.when(i == -best["i"], F.concat(F.lit("☑"), F.substring(F.get("_boxes", i), 2, 1 << 20))).otherwise(F.get("_boxes", i)), F.lit("")))), "")
    return met.withColumn("text", F.when(best["s"] >= least, whole).otherwise(F.col("text"))).select(*lines.columns)
