"""Column functions on labels and values.

The normalisers are not interchangeable: each keeps, drops or replaces different parts
of a label, and choosing another changes what matches.  They expect text folded by
``similarity.nfkc`` (``nfkd`` for ``basic_norm``) where it is not plain ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python sees it: the Unicode property and the separators U+001C-U+001F.
WS = r"(?U)[\s\x1c-\x1f]+"
PUNCT = r"[!-/:-@\[-`{-~]"
# Colon-like characters.
COLONS = ":：﹕꞉˸፡︓"
# Words that mean yes or no, in the wide and in the narrow reading.
YES = ("y", "yes", "true", "1", "x", "✓", "check", "checked")
NO = ("n", "no", "false", "0", "uncheck", "unchecked")
YES_NARROW = ("yes", "true", "y", "checked", "1")
NO_NARROW = ("no", "false", "n", "unchecked", "0")
# Labels that are read as another label.
ALIASES = {"investor name": "name of investor", "name of investor printed or typed": "name of investor"}
# Labels and what else they are called.
SYNONYMS = {
    "last name": ("surname", "family name"),
    "first name": ("given name",),
    "middle initial": ("middle name", "mi"),
    "city, st zip": ("city state zip", "city st zip code"),
    "date of birth": ("dob", "date of birth (dd/mm/yyyy)"),
    "citizen of": ("citizenship", "country of citizenship"),
    "country of residence": ("residence country",),
}
# Fragments of running text that are no field.
BOILERPLATE = (
    "subscription agreement",
    "page ",
    "the investor may also contact",
    "copy documents for any particular recipient",
    "attach additional pages if needed",
)
# Fragments that mark a section heading.
HEADINGS = (
    "for completion by subscribers",
    "investor information",
    "subscription details",
    "wire information",
    "beneficiary bank",
    "intermediary bank",
    "erisa status",
    "signature",
    "for all subscribers",
)
# Labels that are never a heading, and blocks that always are.
NOT_HEADINGS = (
    "Applicant Name", "Last name", "First name", "Middle Initial", "Date of Birth", "Place of Birth", "Citizen of",
    "Country of Residence", "Tax Identification Number", "GIIN (if applicable)", "Jurisdiction of Organisation",
    "Residence (Individual Applicants) or Registered Address (Entity Applicants)", "Street 1", "Street 2", "Street 3",
    "City, ST Zip", "Country", "Work Phone", "Home Phone", "Cell Phone", "Fax", "Email", "E-Mail", "Name",
    "Principal Place of Business (if differs from Registered Address)", "Signature",
)
BLOCKS = (
    "Individual Applicants", "Entity Applicants", "All Applicants", "Authorised Signatories", "Authorized Signatories",
    "Investor Registration Form", "Investor Profile Form",
)
# Labels of data entry that are no option.
ENTRY_LABELS = ("name", "e-mail", "email", "telephone", "facsimile", "fax", "address")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(c: Column, fragments) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in fragments])


# --- white space and suffixes -------------------------------------------------------


def trim_all(c) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(_c(c), rf"^{WS}|{WS}$", "")


def collapse(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), WS, " "))


def drop_parens(c) -> Column:
    return F.regexp_replace(_c(c), r"\(.*?\)", "")


def strip_trailing_paren(c) -> Column:
    """Without one parenthesis at the end."""
    return F.regexp_replace(_c(c), r"(?U)[\s\x1c-\x1f]*\([^()]*\)[\s\x1c-\x1f]*$", "")


def strip_colons(c) -> Column:
    """Without any colon-like characters at the end."""
    return trim_all(F.regexp_replace(_c(c), rf"(?U)[\s\x1c-\x1f{COLONS}]+$", ""))


def strip_one_colon(c) -> Column:
    return F.regexp_replace(_c(c), rf"(?U)[{COLONS}][\s\x1c-\x1f]*$", "")


def delete_punct(c) -> Column:
    return F.regexp_replace(_c(c), PUNCT, "")


# --- normalisers --------------------------------------------------------------------


def normalize(c) -> Column:
    """Without parentheses, collapsed, lower, without ASCII punctuation.  Spaces around
    deleted punctuation stay: ``a - b`` has two."""
    return delete_punct(F.lower(collapse(drop_parens(c))))


def norm_key(c) -> Column:
    """As ``normalize``, but what stands in parentheses stays."""
    return delete_punct(F.lower(collapse(c)))


def section_key(c) -> Column:
    """Lower, collapsed, only word characters and spaces (Unicode)."""
    return F.regexp_replace(collapse(F.lower(_c(c))), r"(?U)[^\w\s]", "")


def strict(c) -> Column:
    """Without one trailing colon, collapsed, lower; keeps parentheses."""
    return F.lower(collapse(strip_one_colon(trim_all(c))))


def strict_match(c) -> Column:
    """As ``strict`` without parentheses: the form that drives matching."""
    return strict(drop_parens(c))


def loose(c) -> Column:
    return delete_punct(F.lower(collapse(strip_one_colon(trim_all(drop_parens(c))))))


def ascii_norm(c) -> Column:
    """Lower; every run that is no ASCII letter or digit is one space."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", " "))


def basic_norm(c) -> Column:
    """For decomposed text: only word characters, spaces and ``-/()``; lower, collapsed."""
    return collapse(F.lower(F.regexp_replace(_c(c), r"(?U)[^\w\s\-/()]", "")))


def dash_key(c) -> Column:
    return F.lower(trim_all(strip_one_colon(F.translate(collapse(c), "–—", "--"))))


def match_text(c) -> Column:
    edge = r"(?U)[\s:\-—–·•]+"
    plain = F.lower(F.regexp_replace(collapse(c), rf"^{edge}|{edge}$", ""))
    return collapse(F.regexp_replace(plain, r"(?U)[^\w\s]", ""))


def inline_norm(c) -> Column:
    """Straight quotes and dashes, collapsed."""
    return collapse(F.translate(_c(c), "“”‘’–—", "\"\"''--"))


def section_spelling(c) -> Column:
    return F.replace(F.lower(trim_all(c)), F.lit("authorized"), F.lit("authorised"))


def alias(c) -> Column:
    """A normalised label, or the label that it is an alias of."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[_c(c)], _c(c))


def synonyms(c) -> Column:
    """Array of a label (in ``ascii_norm``) and what else it is called, normalised."""
    known = {k.replace(",", ""): [v.replace("(", "").replace(")", "").replace("/", " ") for v in vs] for k, vs in SYNONYMS.items()}
    table = F.create_map(*[x for k, vs in known.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])
    return F.array_distinct(F.concat(F.array(_c(c)), F.coalesce(table[_c(c)], F.array().cast("array<string>"))))


# --- values -------------------------------------------------------------------------


def value_text(c) -> Column:
    """Canonical text of a value: ``123.0`` is 123 and ``1.2300`` is 1.23; null is blank."""
    t = trim_all(c)
    t = F.regexp_replace(t, r"^([+-]?\d+)\.0+$", "$1")
    return F.coalesce(F.regexp_replace(t, r"^([+-]?\d+\.\d*?[1-9])0+$", "$1"), F.lit(""))


def number_text(c, places: int = 12) -> Column:
    """Text of a number: whole numbers without a point, others with up to ``places``
    decimals and no trailing zeros; null, NaN and infinities are blank."""
    x = _c(c).cast("double")
    whole = F.abs(x) < 1e15
    text = F.when(whole & (x == F.floor(x)), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", x), "0+$", ""), r"\.$", ""))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "").otherwise(text)


def truthy(c, yes=YES, no=NO) -> Column:
    """True, false, or null where the word says neither."""
    t = F.lower(trim_all(c))
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def clean_index(c: str) -> Column:
    """``#3`` is 3; what is left of digits and minus signs, or null if that is no number."""
    return F.expr(f"try_cast(nullif(regexp_replace(`{c}`, '[^0-9-]+', ''), '') AS bigint)")


def clean_page(c: str) -> Column:
    """A whole number, or null; ``3.0`` is 3."""
    return F.expr(f"try_cast(try_cast(`{c}` AS double) AS bigint)")


def index_or_one(c) -> Column:
    return F.coalesce(F.nullif(_c(c), F.lit(0)), F.lit(1)).cast("long")


def positive_page(c, otherwise=None) -> Column:
    """A page from 1 on; any other is ``otherwise``, null or, in one of the forms, 0."""
    return F.when(_c(c) > 0, _c(c)).otherwise(F.lit(otherwise))


def title(label_short, label, least: int = 6) -> Column:
    """A field's short label, or its label; cut at a colon that has enough before it."""
    t = F.coalesce(F.nullif(collapse(label_short), F.lit("")), collapse(label))
    left = F.trim(F.substring_index(t, ":", 1))
    return F.when(t.contains(":") & (F.length(left) >= least), left).otherwise(t)


def choices_text(choices, separator: str = " | ") -> Column:
    return F.array_join(_c(choices), separator)


def fallback_name(label, section, seq, index) -> Column:
    """The label, or a name made of its place where it is blank or a placeholder."""
    made = F.format_string("Field #%d (Sec: %s, Idx: %d)", _c(seq), F.coalesce(F.nullif(_c(section), F.lit("")), F.lit("No Section")), _c(index))
    return F.when(is_placeholder_label(label), made).otherwise(_c(label))


# --- predicates ---------------------------------------------------------------------


def words(c) -> Column:
    """Words between white space; a blank text has none."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def n_words(c) -> Column:
    return F.size(words(c))


def caps_ratio(c) -> Column:
    """Share of capitals among letters; 0 without letters."""
    letters = F.regexp_count(_c(c), F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(_c(c), F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def token_length(c) -> Column:
    return F.regexp_count(_c(c), F.lit("[A-Za-z0-9]"))


def is_placeholder_label(c) -> Column:
    return F.coalesce(_c(c), F.lit("")).startswith("unknown_") | (F.coalesce(trim_all(c), F.lit("")) == "")


def is_narrative(field, choices) -> Column:
    """Running text rather than a field; checkbox rows never are."""
    f = F.coalesce(trim_all(field), F.lit(""))
    long = (F.length(f) > 120) | (n_words(f) > 20)
    checkbox = F.lower(trim_all(F.coalesce(_c(choices), F.lit("")))) == "checkbox"
    return ~checkbox & ((f == "") | long | _any(F.lower(f), BOILERPLATE))


def _heading(c) -> tuple[Column, Column]:
    t = trim_all(c)
    return t, (F.length(t) > 0) & (F.length(t) <= 180)


def is_heading_relaxed(c) -> Column:
    """A colon at the end, a known fragment, or capitals in a short line."""
    t, fits = _heading(c)
    colon = (F.length(t) > 5) & F.substring(t, -1, 1).isin(*COLONS)
    return fits & (colon | _any(F.lower(t), HEADINGS) | ((caps_ratio(t) >= 0.45) & (n_words(t) <= 15)))


def is_heading(c) -> Column:
    t, fits = _heading(c)
    return fits & (t.endswith(":") | ((caps_ratio(t) >= 0.45) & (n_words(t) <= 15)))


def is_heading_section(c) -> Column:
    t, fits = _heading(c)
    return fits & (F.lower(t).startswith("section ") | is_heading(t))


def is_heading_caps(c) -> Column:
    """Two words or more in capitals, or a word that names a form."""
    capital = F.size(F.filter(words(c), lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    return (trim_all(c) != "") & ((capital >= 2) | F.upper(_c(c)).rlike(r"(FORM|APPLICATION|SIGNATURE|REGISTRATION)\b"))


def is_heading_known(c) -> Column:
    t, fits = _heading(c)
    named = t.isin(*BLOCKS) | ((caps_ratio(t) >= 0.85) & (n_words(t) <= 15))
    return fits & (t.endswith(":") | (~t.isin(*NOT_HEADINGS) & named))


def is_header_by_shape(label, x0, x1, page_x0, page_x1) -> Column:
    """A short title that spans most of its page, or ends with a colon, near the centre."""
    t = collapse(label)
    n = n_words(t)
    starts = F.size(F.filter(words(t), lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}"))) / F.greatest(n, F.lit(1))
    titled = (starts >= 0.55) | (caps_ratio(t) >= 0.55)
    width = F.greatest(F.lit(1.0), _c(page_x1) - _c(page_x0))
    centred = F.abs((_c(x0) + _c(x1)) / 2 - (_c(page_x0) + width / 2)) <= 0.25 * width
    wide = F.greatest(F.lit(0.0), _c(x1) - _c(x0)) / width >= 0.55
    return ~t.rlike(r"\d") & n.between(1, 7) & centred & ((titled & wide) | t.endswith(":"))


def is_short_label(c, most_words: int = 10, most: int = 140) -> Column:
    t = collapse(c)
    return (t != "") & (F.length(t) <= most) & (F.regexp_count(t, F.lit(r"\.")) < 2) & (n_words(t) <= most_words)


def is_short_option(c, most_words: int = 5) -> Column:
    return n_words(c) <= most_words


def is_option_label(c) -> Column:
    """An option rather than a label of data entry."""
    t = trim_all(c)
    # fixed value: the one option that is longer than options are
    report = F.lower(t).rlike(r"\bannual\s*\(audited\)\s*/\s*quarterly\s*\(unaudited\)\s*financial\s*statements\b")
    fits = (F.length(t) <= 140) & (n_words(t) <= 16) & ~F.lower(t).isin(*ENTRY_LABELS)
    return (t != "") & ~t.endswith(":") & (report | fits)


def is_title_case(c) -> Column:
    w = words(c)
    capital = F.size(F.filter(w, lambda x: F.substring(x, 1, 1).rlike(r"\p{Lu}")))
    return (F.size(w) > 0) & (capital >= F.greatest(F.lit(1), F.floor(0.6 * F.size(w))))


def is_placeholder_text(c) -> Column:
    """Blank, two characters at most, or nothing but filler such as underscores."""
    t = F.coalesce(trim_all(c), F.lit(""))
    return (F.length(t) <= 2) | t.rlike(r"^[_\-.\s\u2026\u25a1\u2610]+$")


def is_blank_line(c) -> Column:
    return F.coalesce(collapse(c), F.lit("")).rlike(r"^[_\s.\u2026-]*$")


def has_checkbox(c) -> Column:
    """A checkbox glyph, or bracketed yes and no."""
    t = F.coalesce(_c(c), F.lit(""))
    return t.rlike(r"[\u2610\u2611\u2612\u25a0\u25a1]|\[\s*[xX\u2713]?\s*\]|\( \)") | (t.contains("Yes") & t.contains("No") & t.rlike(r"[\[\]()]"))


def is_label_like(c, stop: tuple = ()) -> Column:
    t = trim_all(c)
    ok = (F.length(t) <= 48) & t.rlike(r"\p{L}") & (caps_ratio(t) < 0.70) & (n_words(t) <= 7)
    return ok & ~_any(F.lower(t), stop) if stop else ok


def is_checkbox_sentence(c) -> Column:
    t = collapse(c)
    long = (F.length(t) >= 24) | (n_words(t) >= 6)
    # fixed values: what sentences beside a checkbox say
    return ~t.rlike(rf"[{COLONS}]\s*$") & long & (t.rlike(r"^\([a-z]\)\s") | _any(F.lower(t), ("tick if applicable", "benefit plan investor", "plan investor", "tick if")))


def significant_words(c, stop: tuple = ()) -> Column:
    """Distinct words of three letters or more, lower, without ``stop``."""
    found = F.array_distinct(F.filter(F.split(F.lower(_c(c)), r"(?U)\W+"), lambda w: F.length(w) >= 3))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def overlaps(a, b, stop: tuple = ()) -> Column:
    return F.arrays_overlap(significant_words(a, stop), significant_words(b, stop))


def dedupe_phrase(c) -> Column:
    """``A B A B`` is ``A B``; the same parenthesis twice at the end is there once."""
    t = F.regexp_replace(collapse(c), r"(\([^()]*\))(\s*\1)+$", "$1")
    w = F.split(t, " ")
    half = (F.size(w) / 2).cast("int")
    twice = (F.size(w) % 2 == 0) & (F.lower(F.array_join(F.slice(w, 1, half), " ")) == F.lower(F.array_join(F.slice(w, half + 1, half), " ")))
    return F.when(twice, F.array_join(F.slice(w, 1, half), " ")).otherwise(t)


def field_type(placement, kind, label, choices) -> Column:
    """What can be filled in: checkbox, dropdown, text, underline, table, or blank."""
    p, k, t = F.lower(collapse(placement)), F.lower(collapse(kind)), collapse(label)
    some = F.coalesce(F.size(_c(choices)), F.lit(0)) > 0
    return (
        F.when(k.contains("check") | p.rlike("acro_check|acro-checkbox"), "checkbox")
        .when(k.rlike("choice|combo|list") | p.contains("acro_choice"), "dropdown")
        .when(k.contains("text") | p.contains("acro_text"), F.when(is_short_label(t), "text").otherwise(""))
        .when(some | t.rlike(r"\[\s*[xX\u2713]?\s*\]|[\u25a1\u2610\u2611\u2612]"), "checkbox")
        .when(p.rlike("underline|line|blank|rule"), F.when(is_short_label(t), "underline").otherwise(""))
        .when(p.rlike("grid|table"), F.when(is_short_label(t, 6, 60), "table").otherwise(""))
        .when(p.rlike("box|square") & is_short_label(t, 8, 80), "text")
        .otherwise("")
    )
