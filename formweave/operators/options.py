"""Splitting labels and tables into rows: options, choices, grids and placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut

RECIPIENT = r"(?i)\brecipient\s*(\d+)\b"
# Fixed value: what stands between options on a line.
INLINE = r"(?i)(?:\t+|\s{2,}|\s+\bOR\b\s+|[;•/])"


def recipient(section, otherwise=1) -> Column:
    """N of ``recipient N`` in a section, or ``otherwise``."""
    found = F.regexp_extract(section, RECIPIENT, 1)
    return F.when(found != "", found.cast("long")).otherwise(F.lit(otherwise).cast("long"))


def choice_rows(fields: DataFrame) -> DataFrame:
    """A row for each of a field's ``options`` (array) in its place: Field is the option,
    Index the recipient of the section, or 1.  Fields without options stay."""
    some = F.coalesce(F.size("options"), F.lit(0)) > 0
    rows = fields.filter(some).withColumn("Field", F.explode("options")).withColumns({"Index": recipient(F.col("Section")), "Choices": F.lit("checkbox")})
    return rows.unionByName(fields.filter(~some).withColumn("Choices", F.lit(""))).drop("options")


def inline_options(c, most_words: int = 8) -> Column:
    """Options on one line: 2 to 10 different parts of few words and three letters or
    more; otherwise an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(F.trim(c), INLINE), lambda p: F.regexp_replace(p, r"^[ \-:]+|[ \-:]+$", ""))
    parts = F.filter(parts, lambda p: T.n_words(p).between(1, most_words) & (T.token_length(p) >= 3))
    first = F.filter(parts, lambda p, i: F.array_position(F.transform(parts, F.lower), F.lower(p)) == i + 1)
    empty = F.array().cast("array<string>")
    return F.when(F.size(first).between(2, 10) & ~F.trim(c).endswith(":"), first).otherwise(empty)


def inline_rows(fields: DataFrame, most_words: int = 8) -> DataFrame:
    """A row for each inline option of a field; a field without stays as it is."""
    found = inline_options("Field", most_words)
    return fields.withColumn("Field", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array("Field"))))


def compound_options(c) -> Column:
    """``Initial Subscription Additional Subscription`` as its pairs of words: at least
    three title words, no digit or colon, 2 to 4 chunks; otherwise an empty array."""
    t = T.collapse(c)
    w = F.split(t, " ")
    titles = F.forall(w, lambda x: x.rlike(r"^\p{Lu}(?:\p{Ll}.*)?$|^(?=.*\p{Lu})[^\p{Ll}]+$"))
    chunks = (F.size(w) / 2).cast("int")
    pair = lambda i: F.array_join(F.slice(w, 2 * i + 1, F.when((i == chunks - 1) & (F.size(w) % 2 == 1), 3).otherwise(2)), " ")
    fits = (t != "") & (F.length(t) <= 60) & ~t.rlike(r"[\d:]") & (F.size(w) >= 3) & titles & chunks.between(2, 4)
    return F.when(fits, F.transform(F.sequence(F.lit(0), chunks - 1), pair)).otherwise(F.array().cast("array<string>"))


def glyph_options(c) -> Column:
    """Options after checkbox glyphs, or between separators where there is no glyph."""
    c = F.col(c) if isinstance(c, str) else c
    glyph = r"[☐☑☒■□]|\[\s*[xX]?\s*\]"
    tidy = lambda parts: F.filter(F.transform(parts, T.collapse), lambda p: p != "")
    return F.when(c.rlike(glyph), tidy(F.split(F.regexp_extract(c, rf"(?s)(?:{glyph}).*$", 0), glyph))).otherwise(tidy(F.split(c, r"\t|\s{2,}|[;•|]")))


def two_labels(c) -> Column:
    """Two labels that share a line: at a wide gap, else a doubled phrase in halves, else
    before the first capital after a small letter; otherwise the one label."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    gap = F.split(t, r"\t+|\s{3,}", 2)
    w = F.split(T.collapse(c), " ")
    half = (F.size(w) / 2).cast("int")
    first, second = F.array_join(F.slice(w, 1, half), " "), F.array_join(F.slice(w, half + 1, half), " ")
    twice = (F.size(w) % 2 == 0) & (F.lower(first) == F.lower(second))
    turn = F.split(T.collapse(c), r"(?<=\p{Ll}) (?=\p{Lu})", 2)
    return F.when(F.size(gap) == 2, gap).when(twice, F.array(first, second)).otherwise(turn)


# Fixed value: two options that one form prints without anything between them.
FUSED = r"(?i)^(Account statements)\s+(Annual\s*\(audited\)\s*/\s*quarterly\s*\(unaudited\)\s*financial\s*statements)$"


def fused_options(c) -> Column:
    """Options that run into each other: the two known phrases, else what stands before and
    after the gap in front of a capitalised word with a parenthesis, if both have two words
    or more; otherwise the one option."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    halves = F.split(t, r"\s+(?=[A-Z][a-z]+\s*\()", 2)
    two = (F.size(halves) == 2) & (T.n_words(F.get(halves, 0)) >= 2) & (T.n_words(F.get(halves, 1)) >= 2)
    known = F.array(F.trim(F.regexp_extract(t, FUSED, 1)), F.trim(F.regexp_extract(t, FUSED, 2)))
    return F.when(t.rlike(FUSED), known).when(two, F.transform(halves, F.trim)).otherwise(F.array(t))




#: Characters of the pieces by which texts and groups meet.
PIECE = 3
#: Groups that are broadcast; more of them are met by shuffles.
GROUPS = 20_000


def _pieces(c, q) -> Column:
    """Different pieces of ``q`` characters of a text."""
    return F.array_distinct(F.when(F.length(c) >= q, F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, F.lit(q)))).otherwise(F.array().cast("array<string>")))


def group_rows(fields: DataFrame, groups: DataFrame) -> DataFrame:
    """Replaces a field that names all options of a group, in order, by its options.

    ``groups`` has labels (array); one group matches a field at most: the first by name.
    Groups without two labels, or with labels of punctuation only, match nothing.

    A text that names a group has every piece of its labels in it.  Each group is entered
    under one, that which the fewest other groups have, and only texts with that piece are
    held against it; so there may be any number of groups.
    """
    norms = F.transform("labels", T.norm_key)
    pattern = F.concat(F.lit("(?s)^.*"), F.array_join(F.transform("labels", lambda x: F.concat(F.lit("\\Q"), T.norm_key(x), F.lit("\\E"))), ".*"), F.lit(".*$"))
    size = F.least(F.array_max(F.transform(norms, F.length)), F.lit(PIECE))
    groups = groups.filter(F.size("labels") >= 2).select("labels", F.array_join(norms, "").alias("_key"), pattern.alias("_pattern"), norms.alias("_norms"), size.alias("_q")).filter("_q > 0")
    # one parameter: Spark hands a second one the place of the label
    each = lambda q: F.transform("_norms", lambda x: _pieces(x, q))
    of_groups = [groups.filter(F.col("_q") == q).withColumn("_piece", F.explode(F.array_distinct(F.flatten(each(q))))) for q in range(1, PIECE + 1)]
    entered = reduce(DataFrame.unionByName, of_groups)
    counts = entered.groupBy("_piece").agg(F.count("*").alias("_n"))
    entered = cut(entered.join(counts, "_piece").groupBy("labels", "_key", "_pattern").agg(F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece")))
    # pieces of texts are many times the table that they come from, and must never be the side that is broadcast
    many = entered.count() > GROUPS
    met = lambda rows, of: rows.hint("merge").join(of, on=rows.columns[-1]) if many else rows.join(F.broadcast(of), on=rows.columns[-1])

    keyed = fields.select("row_no", T.norm_key("Field").alias("_norm"))
    texts = keyed.withColumn("_piece", F.explode(F.concat(*[_pieces(F.col("_norm"), q) for q in range(1, PIECE + 1)])))
    named = met(texts, entered).filter(F.expr("_norm rlike _pattern")).select("row_no", "labels", "_key")
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    same = met(keyed.withColumn("_bare", bare("_norm")), groups.withColumn("_bare", bare("_key")).filter("_bare <> ''")).select("row_no", "labels", "_key")
    first = F.row_number().over(Window.partitionBy("row_no").orderBy("_key", "labels"))
    hit = named.unionByName(same).withColumn("_n", first).filter("_n = 1").drop("_n", "_key")
    rows = fields.join(hit, "row_no").withColumn("Field", F.explode("labels")).select(*fields.columns)
    return fields.join(hit.select("row_no"), "row_no", "left_anti").select(*fields.columns).unionByName(rows)


# What begins a list of options, what stands before one, and between two.
TICK, BULLET, TICK_NOTE, OR = r"(?i)\bplease\s+tick\s+one\b", r"^\s*(?:\((?:[a-eA-E]|i{1,3}|iv|v)\)|[-–•])\s+(.*)$", r"(?i)\s*\(tick[^)]*\)\s*$", r"(?i)\s+\bOR\b\s+"


def line_options(c) -> Column:
    """The options that a line offers: without its bullet and a note such as ``(tick here)``,
    split at OR, as far as they are short labels."""
    t = T.collapse(c)
    bulleted = F.regexp_replace(F.trim(F.regexp_extract(t, BULLET, 1)), TICK_NOTE, "")
    body = F.when(t.rlike(BULLET), bulleted).otherwise(t)
    return F.filter(F.transform(F.split(body, OR), lambda p: F.trim(p)), lambda p: (p != "") & T.is_short_label(p, 24, 140))


def context_options(lines: DataFrame, most: int = 6, long: int = 200) -> DataFrame:
    """Options after a line ``please tick one``: doc_id, line_no, option_line and option, for
    lines after which at least two different ones stand.

    Lines give their options until ``most`` have been gathered; a line that is longer than
    ``long`` is the last, if there is any option by then.  Of options that normalise to the
    same the first counts, and of what was gathered the first ``most``.

    Every option line knows how many options of its document stand before it, so a heading
    meets its lines by that number and no window is opened over all that follows.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "line_no", "text", line_options("text").alias("options")).withColumn("_n", F.size("options"))
    rows = rows.withColumn("_to", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.first(F.when(F.length(T.collapse("text")) > long, F.col("line_no")), ignorenulls=True)
    rows = rows.withColumn("_stop", stop.over(order.rowsBetween(0, Window.unboundedFollowing)))
    heads = rows.filter(F.col("text").rlike(TICK)).select("doc_id", "line_no", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_k"), F.col("_to").alias("_base"))
    given = rows.filter("_n > 0").select(F.col("doc_id").alias("_d"), F.col("line_no").alias("option_line"), "options", (F.col("_to") - F.col("_n")).alias("_from"), "_stop")
    met = heads.join(given, (F.col("doc_id") == F.col("_d")) & (F.col("_base") + F.col("_k") == F.col("_from")))
    # the line with number 0 is the first that has options: no line before it can be the last
    last = F.min(F.when(F.col("_k") == 0, F.col("_stop"))).over(Window.partitionBy("doc_id", "line_no"))
    met = met.withColumn("_last", last).filter("_last IS NULL OR option_line <= _last")
    met = met.select("doc_id", "line_no", "option_line", F.posexplode("options").alias("_p", "option")).withColumn("_key", T.norm_key("option")).filter("_key <> ''")
    first = Window.partitionBy("doc_id", "line_no", "_key").orderBy("option_line", "_p")
    met = met.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    place = Window.partitionBy("doc_id", "line_no").orderBy("option_line", "_p")
    met = met.withColumns({"_at": F.row_number().over(place), "_all": F.count("*").over(Window.partitionBy("doc_id", "line_no"))})
    return met.filter((F.col("_all") >= 2) & (F.col("_at") <= most)).select("doc_id", "line_no", "option_line", "option")


def append_missing(fields: DataFrame, rows: DataFrame, key: str = "Field") -> DataFrame:
    """Adds the rows whose key no field has."""
    return fields.unionByName(rows.join(fields.select(key).distinct(), key, "left_anti").select(*fields.columns))


def matrix_rows(fields: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fields that head a table of n rows (``sizes``: Field, n) get the indexes 2 to n that
    they lack."""
    want = sizes.filter("n >= 2").select("Field", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n").cast("long"))).alias("Index"))
    first = fields.groupBy("Field").agg(F.min_by("Section", "row_no").alias("Section"), F.min("row_no").alias("row_no"))
    lack = want.join(fields.select("Field", "Index"), ["Field", "Index"], "left_anti").join(first, "Field")
    return fields.select("row_no", "Section", "Field", "Index").unionByName(lack.select("row_no", "Section", "Field", "Index"))


def grid_rows(cells: DataFrame) -> DataFrame:
    """Cells of a table under its first row: field (the header), index (the row), value."""
    head = cells.filter("row_no = 0").select("doc_id", "table_no", "col_no", F.col("text").alias("field")).filter("field <> ''")
    body = cells.filter("row_no > 0").select("doc_id", "table_no", "col_no", F.col("row_no").alias("index"), F.col("text").alias("value"))
    return body.join(head, ["doc_id", "table_no", "col_no"]).select("doc_id", "table_no", "field", "index", "value")


def pair_rows(cells: DataFrame) -> DataFrame:
    """Label and value cells side by side: even columns are labels, the next their values."""
    label = cells.filter("col_no % 2 = 0").select("doc_id", "table_no", "row_no", "col_no", F.col("text").alias("field"))
    value = cells.filter("col_no % 2 = 1").select("doc_id", "table_no", "row_no", (F.col("col_no") - 1).alias("col_no"), F.col("text").alias("value"))
    number = F.regexp_extract("field", r"(\d+)", 1)
    index = F.when(number != "", number.cast("long")).otherwise((F.col("col_no") / 2 + 1).cast("long"))
    return label.join(value, ["doc_id", "table_no", "row_no", "col_no"]).select("doc_id", "table_no", "row_no", "field", index.alias("index"), "value")


# The three forms of a placeholder, in the order in which they are applied.
PLACEHOLDERS = (r"\{\{\s*([^{}]+?)\s*\}\}", r"\[\[\s*([^\[\]]+?)\s*\]\]", r"\$\{\s*([^{}]+?)\s*\}")


def fill_placeholders(texts: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """``texts`` (key, text) with every placeholder whose name ``values`` (field_norm,
    value) knows replaced; others stay."""
    out = texts
    for pattern in PLACEHOLDERS:
        found = out.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("token"))
        found = found.withColumn("field_norm", T.norm_key(F.regexp_extract("token", pattern, 1)))
        known = found.join(values, "field_norm").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "value"))).alias("_known"))
        put = F.aggregate("_known", F.col("text"), lambda t, x: F.replace(t, x["token"], x["value"]))
        out = out.join(known, key, "left").withColumn("text", F.when(F.col("_known").isNull(), F.col("text")).otherwise(put)).drop("_known")
    return out


def label_boxes(c) -> Column:
    """Labels with the box that belongs to them: array of (label, box_first), by whether
    the first box stands before or after the first label."""
    c = F.col(c) if isinstance(c, str) else c
    box = r"[☐☑☒■□]|\[\s*[xX]?\s*\]"
    first = F.regexp_instr(F.trim(c), F.lit(box)) == 1
    labels = F.filter(F.transform(F.split(c, box), T.collapse), lambda p: p != "")
    return F.transform(labels, lambda p: F.struct(p.alias("label"), first.alias("box_first")))


def samecell_labels(paragraphs: DataFrame) -> DataFrame:
    """Labels of cells that hold label and blank: a paragraph before a placeholder, the
    text left of an inline blank, else the first line with a letter or digit."""
    w = Window.partitionBy("doc_id", "cell_no").orderBy("par_no")
    inline = F.trim(F.regexp_extract("text", r"^(.*?[^\W_].*?)\s*_{3,}", 1))
    label = F.when(T.is_placeholder_text(F.lead("text").over(w)) & F.lead("text").over(w).isNotNull() & ~T.is_placeholder_text("text"), T.strip_colons("text")).when(inline != "", T.strip_colons(inline))
    rows = paragraphs.withColumn("_label", label).withColumn("_any", F.when(F.col("text").rlike(r"\w"), T.strip_colons("text")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("par_no")))
    return rows.groupBy("doc_id", "cell_no").agg(F.coalesce(first("_label"), first("_any")).alias("label"))


def collapse_recipients(fields: DataFrame) -> DataFrame:
    """In a section of a recipient and page with two short options or more, the options
    are numbered: ``section – item k``, with the recipient as Index."""
    option = F.col("Section").rlike(RECIPIENT) & T.is_option_label("Field")
    # only options are dealt by their section, which may hold most of the sheet without any; the
    # neighbours tell whether there are two, so no section is held to be counted
    order = Window.partitionBy("Section", "Page").orderBy("row_no")
    rows = fields.withColumn("_o", option)
    options = rows.filter("_o").withColumns({"_k": F.row_number().over(order), "_next": F.lead(F.lit(1)).over(order)})
    rows = options.unionByName(rows.filter("_o IS NULL OR NOT _o").withColumns({"_k": F.lit(None).cast("int"), "_next": F.lit(None).cast("int")}))
    put = (F.col("_k") > 1) | F.col("_next").isNotNull()
    new = {
        "Field": F.when(put, F.format_string("%s – item %d", "Section", "_k")).otherwise(F.col("Field")),
        "Index": F.when(put, recipient(F.col("Section"))).otherwise(F.col("Index")),
        "Choices": F.when(put, "checkbox").otherwise(F.col("Choices")),
    }
    return rows.withColumns(new).drop("_o", "_k", "_next")


def export_keys(by: str = "page") -> list:
    """What the exported sheet is sorted by: ``page`` (blank last), ``folded`` (the same
    without regard to case) or ``section``; row_no decides among equals."""
    page = F.coalesce("Page", F.lit(999999))
    orders = {"page": [page, "Section", "Field", "Index"], "folded": [page, F.lower("Section"), F.lower("Field"), "Index"], "section": ["Section", "Field", "Index", page]}
    return [*orders[by], "row_no"]


def export_order(fields: DataFrame, by: str = "page") -> DataFrame:
    """The rows of the exported sheet in order of ``export_keys``."""
    return fields.orderBy(*export_keys(by))
