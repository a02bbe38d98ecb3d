"""Joins by place: as-of, nearest, band and overlap joins on positioned text.

Every join has (doc_id, page) as an equality, so it is dealt by page.  Joins by distance
are dealt by bands as well, and neighbouring bands are probed, so a dense page is no cross
product; what has an upper and a lower end is entered in all bands that it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

PAGE = ["doc_id", "page"]


def section_asof(fields: DataFrame, sections: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``fields`` with the last section (name) at or above its y; among equal y the one
    that is last by name."""
    marks = sections.select(*PAGE, F.col("y1").alias("y"), F.col("name"), F.lit(0).alias("_field"), F.lit(None).cast(fields.schema["field_no"].dataType).alias("field_no"))
    rows = fields.select(*PAGE, (F.col("y") + tolerance).alias("y"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("_field"), "field_no")
    w = Window.partitionBy(*PAGE).orderBy("y", "_field", "name").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(rows).withColumn("section", F.last("name", ignorenulls=True).over(w)).filter("_field = 1")
    return filled.select(*PAGE, "field_no", "section")


def section_marks(lines: DataFrame, expected: DataFrame | None = None, large: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """Section headings of positioned lines (text, y_mid, max_size): with the ``width`` of a
    page and the lines' x0 and x1 by their shape, and by their text, by a size of at least
    the page's 80th percentile, and by likeness to an expected section.  One for each name
    and y to one decimal.

    By shape a heading has no digit and at most 16 words, apart from a parenthesis at its
    end, and takes 0.45 of the page or has half of its words capitalised.
    """
    size = large if large is not None else font_size(lines)
    rows = lines.withColumn("name_norm", T.section_key("text")).filter("name_norm <> ''")
    passes = []
    if width is not None:
        core = T.strip_trailing_paren(T.collapse("text"))
        words = T.words(core)
        titles = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}"))) >= 0.5 * F.size(words)
        wide = (F.col("x1") - F.col("x0")) / width >= 0.45
        passes.append(rows.filter(~core.rlike(r"(?U)\d") & F.size(words).between(1, 16) & (wide | titles)).withColumn("name_norm", T.section_key(core)).filter("name_norm <> ''"))
    passes += [rows.filter(T.is_heading_relaxed("text")), rows.join(size, PAGE).filter("max_size >= p80").drop("p80")]
    if expected is not None:
        names = expected.select("section_norm").filter("section_norm <> ''").distinct()
        near = 2 * F.least(F.length("name_norm"), F.length("section_norm")) >= 0.82 * (F.length("name_norm") + F.length("section_norm"))
        # names that are alike have lengths that are; they meet by the lengths that allow it
        span = F.sequence(F.floor(F.length("section_norm") * 0.82 / 1.18).cast("int"), F.ceil(F.length("section_norm") * 1.18 / 0.82).cast("int"))
        pairs = rows.select("name_norm").distinct().withColumn("_n", F.length("name_norm")).join(names.withColumn("_n", F.explode(span)), "_n").filter(near)
        alike = pairs.filter(S.sm_ratio("name_norm", "section_norm") >= 0.82).select("name_norm").distinct()
        passes.append(rows.join(alike, "name_norm", "left_semi"))
    found = None
    for i, p in enumerate(passes):
        p = p.select(*PAGE, "text", "name_norm", "y_mid", "line_no", F.lit(i).alias("pass"))
        found = p if found is None else found.unionByName(p)
    first = Window.partitionBy(*PAGE, "name_norm", F.bround("y_mid", 1)).orderBy("pass", "line_no")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*PAGE, F.col("text").alias("name"), "name_norm", F.col("y_mid").alias("y1"))


def font_size(lines: DataFrame) -> DataFrame:
    """The page's size at rank ``int(0.8 (n - 1))`` of the positive ones."""
    sizes = F.sort_array(F.collect_list(F.when(F.col("max_size") > 0, F.col("max_size"))))
    return lines.groupBy(*PAGE).agg(sizes.alias("_s")).filter(F.size("_s") > 0).select(*PAGE, F.element_at("_s", (F.floor(0.8 * (F.size("_s") - 1)) + 1).cast("int")).alias("p80"))


def letter_headers(spans: DataFrame) -> DataFrame:
    """Spans that are a letter such as ``(A)`` or ``A.``, once for each place."""
    found = spans.filter((F.length("text") <= 6) & F.trim("text").rlike(r"^(?:\([A-Z]\)|[A-Z]\.)$"))
    return found.select(*PAGE, F.trim("text").alias("letter"), F.bround("y0", 1).alias("y")).distinct()


#: Bands are so many times as high as the distance that is looked for, so that most rows are
#: entered in one band only.
ROOM = 4


def _banded(left: DataFrame, right: DataFrame, ly: str, ry: str, reach: float, how: str = "inner", on: Column | None = None, below: float | None = None) -> DataFrame:
    """Joins rows of a page whose y differ by less than ``reach``, by bands.  With ``below``
    the right one is so far below the left one at most.  Neither side is broadcast: the
    planner knows the size of files, not that of their rows."""
    band = ROOM * reach
    below = reach if below is None else below
    left = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(ly) - reach) / band), F.floor((F.col(ly) + below) / band))))
    right = right.withColumn("_rb", F.floor(F.col(ry) / band)).withColumnsRenamed({c: f"r_{c}" for c in PAGE})
    near = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & (F.col("_b") == F.col("_rb")) & (F.abs(F.col(ly) - F.col(ry)) < reach)
    return left.join(right.hint("merge"), near & on if on is not None else near, how)


def _named(blocks: DataFrame) -> DataFrame:
    """Blocks with text, with their corners and their middle."""
    return blocks.filter(F.trim("text") != "").select(*PAGE, "block_no", "text", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), ((F.col("y0") + F.col("y1")) / 2).alias("bym"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))


def left_label(slots: DataFrame, blocks: DataFrame, dy: float = 18, slack: float = 4) -> DataFrame:
    """field_no and label of the slots (field_no, x0, y) that have a block on their row which
    ends left of them, give or take ``slack``: the nearest, the first among equals."""
    s = slots.select(*PAGE, "field_no", "x0", "y")
    same = _banded(s, _named(blocks), "y", "bym", dy, on=F.col("bx1") <= F.col("x0") + slack)
    return same.groupBy("field_no").agg(F.min_by(_line("y"), F.struct(F.col("x0") - F.col("bx1"), F.col("block_no"))).alias("label")).filter("label IS NOT NULL")


def nearest_label(slots: DataFrame, blocks: DataFrame, dy: float = 18, slack: float = 4, above: float = 36) -> DataFrame:
    """The label of a slot (field_no, x0, y): the nearest block that ends left of it on its
    row, give or take ``slack``; else the nearest above it that begins no further right, of
    equally near ones that with the smallest gap.  Blank blocks are no labels; ties go to
    the first block."""
    s = slots.select(*PAGE, "field_no", "x0", "y")
    same = left_label(slots, blocks, dy, slack).withColumnRenamed("label", "same_row")
    over = _banded(s, _named(blocks), "y", "by1", above, on=(F.col("by1") <= F.col("y")) & (F.col("bx0") <= F.col("x0")), below=0)
    over = over.groupBy("field_no").agg(F.min_by(_line("y"), F.struct(F.col("y") - F.col("by1"), F.col("x0") - F.col("bx1"), F.col("block_no"))).alias("over"))
    out = s.join(same.hint("merge"), "field_no", "left").join(over.hint("merge"), "field_no", "left")
    return out.select("field_no", F.coalesce("same_row", "over").alias("label"), F.when(F.col("same_row").isNotNull(), "row").when(F.col("over").isNotNull(), "above").alias("how"))


def overlap_above(slots: DataFrame, blocks: DataFrame, above: float = 36, least: float = 6, share: float = 0.1) -> DataFrame:
    """The nearest block above a slot (x0, x1, y) that overlaps it by ``least`` and by
    ``share`` of the narrower width; of equally near ones that with the smallest gap."""
    b = blocks.filter(F.trim("text") != "").select(*PAGE, "block_no", "text", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    wide = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    narrow = F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("bx1") - F.col("bx0")))
    hit = (F.col("by1") <= F.col("y")) & (wide >= least) & (wide >= share * narrow)
    found = _banded(slots.select(*PAGE, "field_no", "x0", "x1", "y"), b, "y", "by1", above, on=hit, below=0)
    return found.groupBy("field_no").agg(F.min_by(_line("y"), F.struct(F.col("y") - F.col("by1"), F.col("x0") - F.col("bx1"), F.col("block_no"))).alias("label"))


def checkbox_label(boxes: DataFrame, blocks: DataFrame, dy: float = 18, slack: float = 0) -> DataFrame:
    """The label of a checkbox: the nearest block on its right, else on its left, by the
    sum of vertical distance and gap.  A block may reach ``slack`` into the box."""
    b = blocks.filter(F.trim("text") != "").select(*PAGE, "block_no", "text", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), ((F.col("y0") + F.col("y1")) / 2).alias("bym"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    pairs = _banded(boxes.select(*PAGE, "field_no", "x0", "x1", "cy"), b, "cy", "bym", dy)
    right, left = F.col("bx0") >= F.col("x1") - slack, F.col("bx1") <= F.col("x0") + slack
    score = lambda gap: F.struct(F.abs(F.col("cy") - F.col("bym")) + F.greatest(gap, F.lit(0.0)), F.col("block_no"))
    found = pairs.groupBy("field_no").agg(
        F.min_by(_line("cy"), F.when(right, score(F.col("bx0") - F.col("x1")))).alias("right"),
        F.min_by(_line("cy"), F.when(left, score(F.col("x0") - F.col("bx1")))).alias("left"),
    )
    return found.select("field_no", F.coalesce("right", "left").alias("label"))


def line_label(slots: DataFrame, lines: DataFrame, dy: float = 36, pad: float = 28) -> DataFrame:
    """The label of a typed blank: the nearest line (text, x0, x1, y_mid) of another height
    or place that is no blank itself, by vertical distance and then by how far apart they
    begin; a line that ends more than ``pad`` left of the blank is too far."""
    other = lines.filter(~F.col("text").rlike("_{3,}") & (F.trim("text") != "")).select(*PAGE, "line_no", "text", F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), F.col("y_mid").alias("ly"))
    near = _banded(slots.select(*PAGE, "field_no", "x0", "y"), other, "y", "ly", dy + 1, on=(F.abs(F.col("y") - F.col("ly")) <= dy) & (F.col("lx1") >= F.col("x0") - pad))
    return near.groupBy("field_no").agg(F.min_by(F.trim("text"), F.struct(F.abs(F.col("y") - F.col("ly")), F.abs(F.col("lx0") - F.col("x0")), F.col("line_no"))).alias("label"))


def line_in_block(c, part: Column) -> Column:
    """The line of a block that a height belongs to, from 0 at its top to 1 at its bottom: of
    its lines with text the first down to 0.33 and the last from 0.66 on; between these the
    last from the middle on, else the first.  A block without height gives its last."""
    lines = F.filter(F.transform(F.split(c, r"[\r\n]+"), T.trim_all), lambda x: x != "")
    first = (part <= 0.33) | ((part < 0.66) & (part < 0.5))
    return F.when(F.size(lines) > 0, F.when(F.coalesce(first, F.lit(False)), F.get(lines, 0)).otherwise(F.element_at(lines, -1)))


def _line(y: str) -> Column:
    """The line of a block (text, by0, by1) at ``y``."""
    return line_in_block(F.col("text"), F.when(F.col("by1") > F.col("by0"), (F.col(y) - F.col("by0")) / (F.col("by1") - F.col("by0"))))


def clusters(spans: DataFrame, gap: float = 35, keys: tuple = ("doc_id", "page", "line_no")) -> DataFrame:
    """Spans of a line, from left to right, joined while one begins at most ``gap`` behind
    the end of the one before it.  Blank spans are left out."""
    place = [c for c in ("x0", "y0", "x1", "text") if c in spans.columns]
    w = Window.partitionBy(*keys).orderBy(*place)
    rows = spans.filter(F.trim("text") != "").withColumn("_last", F.lag("x1").over(w))
    rows = rows.withColumn("cluster", F.sum(F.when(F.col("x0") - F.col("_last") > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place))), lambda x: F.trim(x["text"])), " ")
    return rows.groupBy(*keys, "cluster").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"))


def headers(slots: DataFrame, spans: DataFrame, above: float = 48, gap: float = 35) -> DataFrame:
    """field_no and header of slots with a line above: of the nearest line that ends above it, at most
    ``above`` away, the cluster that overlaps the slot most, or if none does the one with the
    nearest centre; the leftmost among equals.  Null if the nearest line is a single cluster:
    no other line is looked at then."""
    line = ["doc_id", "page", "line_no"]
    y = spans.filter(F.trim("text") != "").groupBy(*line).agg(F.max("y1").alias("ly1"))
    s = slots.select(*PAGE, "field_no", F.col("x0").alias("sx0"), F.col("x1").alias("sx1"), "y")
    # bands reach a little further, since a line just ``above`` away counts
    near = _banded(s, y, "y", "ly1", above + 1, on=(F.col("ly1") < F.col("y")) & (F.col("y") - F.col("ly1") <= above), below=0)
    pick = near.groupBy(*PAGE, "field_no", "sx0", "sx1").agg(F.max_by("line_no", F.struct("ly1", -F.col("line_no"))).alias("line_no"))
    found = pick.join(clusters(spans, gap).hint("merge"), line)
    overlap = F.greatest(F.lit(0.0), F.least("sx1", "x1") - F.greatest("sx0", "x0"))
    centre = F.abs((F.col("sx0") + F.col("sx1")) / 2 - (F.col("x0") + F.col("x1")) / 2)
    best = F.max_by("text", F.struct(overlap, F.when(overlap > 0, 0.0).otherwise(-centre), -F.col("x0")))
    return found.groupBy("field_no").agg(F.when(F.count("*") >= 2, best).alias("header"))


def column_header(slots: DataFrame, spans: DataFrame, above: float = 48, gap: float = 35) -> DataFrame:
    """field_no and header of every slot, as ``headers`` finds it; blank without one."""
    found = headers(slots, spans, above, gap)
    return slots.select("field_no").join(found.hint("merge"), "field_no", "left").select("field_no", F.coalesce("header", F.lit("")).alias("header"))


def recipient_bands(heads: DataFrame, boxes: DataFrame, items: int | None = None) -> DataFrame:
    """Boxes between a heading and the next belong to it; the k-th, down the left column
    and then the right, is its item k.  Headings and boxes go in one order, and a box
    belongs to the last heading at or above it."""
    rows = heads.select(*PAGE, "y0", F.lit(0).alias("_box"), F.col("recipient"), F.lit(None).cast("double").alias("x0"), F.lit(None).cast("long").alias("box_no"))
    rows = rows.unionByName(boxes.select(*PAGE, "y0", F.lit(1).alias("_box"), F.lit(None).cast(rows.schema["recipient"].dataType).alias("recipient"), F.col("x0").cast("double").alias("x0"), "box_no"))
    w = Window.partitionBy(*PAGE).orderBy("y0", "_box", "recipient").rowsBetween(Window.unboundedPreceding, 0)
    hit = rows.withColumn("recipient", F.last("recipient", ignorenulls=True).over(w)).filter("_box = 1 AND recipient IS NOT NULL")
    middle = F.avg("x0").over(Window.partitionBy(*PAGE, "recipient"))
    hit = hit.withColumn("_right", F.col("x0") > middle)
    k = F.row_number().over(Window.partitionBy(*PAGE, "recipient").orderBy("_right", "y0", "x0", "box_no"))
    out = hit.withColumn("item", k.cast("long")).select(*PAGE, "box_no", "recipient", "item")
    return out.filter(F.col("item") <= items) if items else out


def yes_no_token(points: DataFrame, blocks: DataFrame, dy: float = 24, dx: float = 140) -> DataFrame:
    """The nearest block of at most six characters that says yes or no."""
    token = F.lower(F.regexp_replace("text", T.PUNCT, ""))
    b = blocks.filter(F.length("text") <= 6).select(*PAGE, "block_no", F.trim(token).alias("token"), F.col("x0").alias("bx0"), ((F.col("y0") + F.col("y1")) / 2).alias("bym")).filter("token IN ('yes', 'no')")
    near = _banded(points.select(*PAGE, "field_no", "x", "y"), b, "y", "bym", dy, on=F.abs(F.col("x") - F.col("bx0")) <= dx)
    return near.groupBy("field_no").agg(F.min_by("token", F.struct(F.abs(F.col("x") - F.col("bx0")), F.col("block_no"))).alias("token"))


#: Height of the bands in which things that have a height meet.
BAND = 64.0


def _reaching(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """Rows once for every band that they reach into."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / BAND), F.floor(F.greatest(low, high) / BAND))))


def _overlapping(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, on: Column) -> DataFrame:
    """Rows of a page that share a band and meet ``on``; pairs that share several bands are
    there for the first of them only."""
    right = _reaching(right, other_low, other_high, "_rb").withColumnsRenamed({c: f"r_{c}" for c in PAGE})
    first = F.col("_b") == F.greatest(F.floor(F.col(low) / BAND), F.floor(F.col(other_low) / BAND))
    same = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page") == F.col("r_page")) & (F.col("_b") == F.col("_rb"))
    return _reaching(left, low, high, "_b").join(right.hint("merge"), same & first & on)


def intersecting_widget(rects: DataFrame, widgets: DataFrame) -> DataFrame:
    """The first widget that a rectangle meets, checkboxes and radio buttons before others."""
    w = widgets.select(*PAGE, "widget_no", "kind", *[F.col(c).alias(f"w{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = _overlapping(rects, w, "y0", "y1", "wy0", "wy1", F.expr("x0 < wx1 AND wx0 < x1 AND y0 < wy1 AND wy0 < y1"))
    return hit.groupBy("field_no").agg(F.min_by("widget_no", F.struct(~F.col("kind").isin("checkbox", "radio"), F.col("widget_no"))).alias("widget_no"))


def box_left_of(labels: DataFrame, boxes: DataFrame, dx: float = 260) -> DataFrame:
    """The nearest box left of a label that overlaps its height."""
    b = boxes.select(*PAGE, "box_no", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    on = (F.col("bx1") <= F.col("x0")) & (F.col("x0") - F.col("bx1") <= dx) & (F.col("by0") < F.col("y1")) & (F.col("y0") < F.col("by1"))
    hit = _overlapping(labels, b, "y0", "y1", "by0", "by1", on)
    return hit.groupBy("label_no").agg(F.min_by("box_no", F.struct(F.col("x0") - F.col("bx1"), F.col("box_no"))).alias("box_no"))


def cell_snap(points: DataFrame, rules: DataFrame, least: float = 28, most: float = 540) -> DataFrame:
    """The cell between the consecutive vertical rules around a point, if its width fits.
    An as-of join: of rules and points in one order, a point's cell is that of the last rule."""
    w = Window.partitionBy(*PAGE).orderBy("x")
    cells = rules.select(*PAGE, "x").distinct().withColumn("right", F.lead("x").over(w))
    rows = cells.select(*PAGE, "x", F.struct("x", "right").alias("cell"), F.lit(0).alias("_point"), F.lit(None).cast("long").alias("field_no"))
    rows = rows.unionByName(points.select(*PAGE, "x", F.lit(None).cast(rows.schema["cell"].dataType).alias("cell"), F.lit(1).alias("_point"), "field_no"))
    order = Window.partitionBy(*PAGE).orderBy("x", "_point").rowsBetween(Window.unboundedPreceding, 0)
    hit = rows.withColumn("cell", F.last("cell", ignorenulls=True).over(order)).filter("_point = 1")
    return hit.filter((F.col("cell.right") - F.col("cell.x")).between(least, most)).select("field_no", F.col("cell.x").alias("left"), F.col("cell.right").alias("right"))


def scan_up(cells: DataFrame) -> DataFrame:
    """Blank cells with the nearest text above them in their column."""
    w = Window.partitionBy("doc_id", "table_no", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("label", F.last(F.nullif(F.trim("text"), F.lit("")), ignorenulls=True).over(w))
    return rows.filter("trim(text) = '' AND label IS NOT NULL").select("doc_id", "table_no", "row_no", "col_no", "label")


def table_sections(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """The section of a table: its single-cell first row, else the last paragraph with text
    before it."""
    rows = blocks.select("doc_id", "block_no", F.nullif(F.trim("text"), F.lit("")).alias("text"), F.lit(None).cast("long").alias("table_no")).unionByName(tables.select("doc_id", "block_no", F.lit(None).cast("string").alias("text"), "table_no"))
    w = Window.partitionBy("doc_id").orderBy("block_no", F.col("table_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("before", F.last("text", ignorenulls=True).over(w)).filter("table_no IS NOT NULL").select("doc_id", "table_no", "before")
    return tables.join(last, ["doc_id", "table_no"]).select("doc_id", "table_no", F.coalesce(F.nullif(F.trim("single"), F.lit("")), "before").alias("section"))


def prefix_match(paragraphs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Paragraphs that are a label of the sheet, or begin with one and a space or colon;
    the first label of the sheet wins.  Joined by the labels' first word."""
    word = lambda c: F.regexp_extract(c, r"^([^ :]+)", 1)
    p = paragraphs.withColumn("key", T.dash_key("text")).withColumn("_w", word("key"))
    k = lookup.select(T.dash_key("Field").alias("field_key"), "row_no").filter("field_key <> ''").withColumn("_w", word("field_key"))
    hit = p.join(k, "_w").filter("key = field_key OR startswith(key, concat(field_key, ' ')) OR startswith(key, concat(field_key, ':'))")
    return hit.groupBy("par_no").agg(F.min("row_no").alias("row_no"))


def page_bounds(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.min("x0").alias("min_x"), F.max("x1").alias("max_x"))


def line_envelopes(spans: DataFrame) -> DataFrame:
    """Lines from spans: box, mean y, largest size and text from left to right.  Lines of
    different blocks (block_no, if there) are different lines."""
    keys = ["doc_id", "page", *(["block_no"] if "block_no" in spans.columns else []), "line_no"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_no", "text"))), lambda x: x["text"]), " ")
    return spans.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("y_mid"), F.max("size").alias("max_size"), text.alias("text"))


def longest_run(runs: DataFrame) -> DataFrame:
    """The longest group of consecutive placeholder runs of a paragraph (the first among
    equals): first and last run and the number of characters."""
    w = Window.partitionBy("par_no").orderBy("run_no")
    rows = runs.withColumn("_p", T.is_blank_line("text") & (F.length("text") > 0))
    rows = rows.withColumn("_g", F.sum(F.when(F.col("_p"), 0).otherwise(1)).over(w)).filter("_p")
    groups = rows.groupBy("par_no", "_g").agg(F.min("run_no").alias("first_run"), F.max("run_no").alias("last_run"), F.sum(F.length("text")).alias("chars"))
    best = F.max(F.struct("chars", (-F.col("first_run")).alias("_first"), "last_run"))
    return groups.groupBy("par_no").agg(best.alias("_b")).select("par_no", (-F.col("_b._first")).alias("first_run"), "_b.last_run", "_b.chars")
