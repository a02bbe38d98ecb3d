"""Which pass fills what.

A document is filled in passes; each pass offers values for targets, and what an earlier
pass fills a later one leaves.  All passes look at the original text, so a target is
decided by the order of the passes alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import choices as C
from ..operators import discovery as D
from ..operators import occurrence as O
from ..operators import options as P
from ..operators import resolve as R
from ..operators import spatial
from ..operators.folding import folded
from ..sources.shared import cut

# The order of the passes, in general and where tables come early.
ORDER = ("placeholders", "inline_groups", "checkboxes", "two_column_checkboxes", "underlines", "option_groups", "grids", "tables", "matrix")
EARLY_MATRIX = ("placeholders", "inline_groups", "checkboxes", "two_column_checkboxes", "matrix", "grids", "tables", "underlines", "option_groups")


def first_pass(offers: dict[str, DataFrame], order: tuple = ORDER, glyphs: bool = True) -> DataFrame:
    """target, pass and value: for each target the offer of the first pass that has one that
    is not blank, the first by emit_no within it.  Without ``glyphs`` in the document the
    passes over checkboxes are left out."""
    some = [n for n in order if n in offers and (glyphs or "checkbox" not in n)]
    rows = [offers[n].select("target", "emit_no", "value", F.lit(n).alias("pass"), F.lit(i).alias("_rank")) for i, n in enumerate(some)]
    rows = reduce(DataFrame.unionByName, rows).filter("value IS NOT NULL AND value <> ''")
    w = Window.partitionBy("target").orderBy("_rank", "emit_no")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("target", "pass", "value")


# Fixed value: which pass fills what discovery finds.
PASS_OF = {
    "docx_underline_inline": "underlines", "docx_underline_inline_spacey": "underlines", "docx_underline_nextline": "underlines", "docx_checkbox_line": "checkboxes",
    "docx_table_grid_header": "grids", "docx_table_grid_row": "matrix", "docx_table_pair": "tables", "docx_table_pair_row": "tables", "docx_table_samecell": "tables",
}
BLANK, BOX = r"_{3,}|[\u2000-\u200B\u00A0.\-–—]{3,}", r"[☐☑☒■□]|\[\s*[xX]?\s*\]"


def _written(text, value, placement):
    """The text of a target with its value: a checkbox is ticked or cleared, a blank is
    filled, an empty cell or line becomes the value."""
    yes = T.truthy(value)
    ticked = F.when(yes.isNotNull(), F.regexp_replace(text, BOX, F.when(yes, "☑").otherwise("☐")))
    has = text.rlike(BLANK) & ~T.is_blank_line(text)
    filled = F.concat(F.regexp_extract(text, rf"(?s)^(.*?)(?:{BLANK})", 1), value, F.regexp_extract(text, rf"(?s)^.*?(?:{BLANK})_*(.*)$", 1))
    inside = F.col("placement").isin("docx_table_samecell") & ~has
    return F.when(placement == "docx_checkbox_line", ticked).when(has, filled).when(inside, F.concat(text, F.lit("\n"), value)).otherwise(value)


def offers(blocks: DataFrame, cells: DataFrame, lookup: DataFrame) -> dict[str, DataFrame]:
    """What each pass offers for a document: target (doc_id, place, row, col), emit_no, value
    (the target's new text), label and idx.

    ``blocks`` (doc_id, block_no, kind, text) and ``cells`` (doc_id, table_no, row_no, col_no,
    text) as ``sources.docx`` reads them; ``lookup`` as ``operators.lookup`` cleans it, with
    keys.  Placeholders go by their names, all other passes by the fields that discovery
    finds and the value that the document agent's resolver gives them.
    """
    held = blocks.filter("kind = 'para'").select("doc_id", F.col("block_no").alias("place"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), "text")
    held = held.unionByName(cells.select("doc_id", (F.col("table_no") + 1000000).alias("place"), F.col("row_no").alias("row"), F.col("col_no").alias("col"), "text"))
    at = ["doc_id", "place", "row", "col"]
    named = held.withColumn("id", F.struct(*at)).select("id", "text")
    values = lookup.filter("Value <> ''").groupBy("field_norm").agg(F.min_by("Value", "row_no").alias("value"))
    new = P.fill_placeholders(named, values).join(named.withColumnRenamed("text", "_old"), "id").filter("text <> _old")
    boxed = {"inline_groups": C.inline_groups(held, lookup), "two_column_checkboxes": C.two_column_boxes(cells, lookup), "option_groups": C.option_groups(cells, lookup)}
    out = boxed | {"placeholders": new.select(F.col("id").alias("target"), F.lit(0).cast("long").alias("emit_no"), F.col("text").alias("value"), F.lit("").alias("label"), F.lit(1).cast("long").alias("idx"))}
    fields = folded(cut(D.docx_fields(blocks, cells, True)), "section", "label").withColumn("field_no", F.struct("doc_id", "emit_no"))
    asked = fields.select("field_no", T.alias(T.normalize("label")).alias("label_norm"), F.lit(None).cast("long").alias("page"), T.normalize("section").alias("section_norm"), F.col("index").alias("occ"))
    plain = asked.filter(~F.col("section_norm").rlike(r"^contact \d+$"))
    found = R.resolve_agent(plain, lookup).select("field_no", "value").unionByName(R.resolve_contact(asked, lookup, R.SIMILAR).select("field_no", "value"))
    rows = fields.join(found, "field_no").withColumns({c: F.col(c).cast("long") for c in ("place", "row")})
    # two labels on a line have places of their own in it, but one text
    rows = rows.withColumn("_col", F.when(F.col("place") < 1000000, 0).otherwise(F.col("col")).cast("long"))
    text = held.select("doc_id", "place", "row", F.col("col").alias("_col"), "text")
    rows = rows.join(text, ["doc_id", "place", "row", "_col"]).withColumn("value", _written(F.col("text"), F.col("value"), F.col("placement")))
    rows = cut(rows.select("doc_id", "place", "row", "_col", "emit_no", "value", "label", "index", "placement"))
    for name in dict.fromkeys(PASS_OF.values()):
        mine = rows.filter(F.col("placement").isin([p for p, n in PASS_OF.items() if n == name]))
        out[name] = mine.select(F.struct("doc_id", "place", "row", F.col("_col").alias("col")).alias("target"), "emit_no", "value", "label", F.col("index").alias("idx"))
    return out


def last_chance(blocks: DataFrame, lookup: DataFrame) -> DataFrame:
    """What is offered when all passes are done, as ``offers`` gives it: a paragraph that is
    a label of the sheet, or begins with one and a space or colon, is the n-th visit of it
    and takes the row of that index (none counts as 1).  The value goes into the next
    paragraph if that is a blank, else behind the label unless it already says so."""
    paras = blocks.filter("kind = 'para' AND trim(text) <> ''")
    order = Window.partitionBy("doc_id").orderBy("block_no")
    rows = blocks.filter("kind = 'para'").withColumns({"_next": F.lead("text").over(order), "_next_no": F.lead("block_no").over(order)})
    keyed = paras.withColumn("par_no", F.struct("doc_id", "block_no"))
    some = lookup.filter("Value <> ''")
    names = some.groupBy("field_norm").agg(F.min("row_no").alias("row_no"), F.min_by("Field", "row_no").alias("Field"))
    hits = spatial.prefix_match(keyed, names).join(names.select("row_no", "field_norm", "Field"), "row_no")
    hits = hits.select("par_no.*", "field_norm", F.col("Field").alias("label"))
    hits = O.occurrence(hits.withColumn("emit_no", F.col("block_no")), ["doc_id", "field_norm"])
    values = some.groupBy("field_norm", F.greatest(F.lit(1).cast("long"), F.coalesce("Index", F.lit(1))).alias("idx")).agg(F.min_by("Value", "row_no").alias("given"))
    met = hits.join(values, ["field_norm", "idx"]).join(rows.select("doc_id", "block_no", "text", "_next", "_next_no"), ["doc_id", "block_no"])
    below = F.col("_next").isNotNull() & T.is_placeholder_text("_next")
    met = met.filter(below | ~F.contains("text", "given"))
    place = F.when(below, F.col("_next_no")).otherwise(F.col("block_no"))
    new = F.when(below, F.col("given")).otherwise(F.concat(F.rtrim("text"), F.lit(" "), "given"))
    return met.select(F.struct("doc_id", place.alias("place"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col")).alias("target"), "emit_no", new.alias("value"), "label", "idx")


def document_plan(blocks: DataFrame, cells: DataFrame, lookup: DataFrame, order: tuple = ORDER) -> DataFrame:
    """One row for each place of a document that is filled: doc_id, place, row, col, pass and
    text.  Passes go in ``order``; checkbox passes are left out of documents without a
    glyph, and ``last_chance`` comes after all and to no place that a pass has filled."""
    found = offers(blocks, cells, lookup) | {"last_chance": last_chance(blocks, lookup)}
    glyphs = blocks.select("doc_id", "text").unionByName(cells.select("doc_id", "text")).filter(T.has_checkbox("text")).select("doc_id").distinct()
    for name in ("checkboxes", "two_column_checkboxes"):
        found[name] = found[name].withColumn("doc_id", F.col("target.doc_id")).join(glyphs, "doc_id", "left_semi").drop("doc_id")
    plan = first_pass(found, (*order, "last_chance"))
    return plan.select("target.*", "pass", F.col("value").alias("text"))
