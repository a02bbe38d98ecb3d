"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans are matches of fixed patterns.  Weak candidates (long mixed-case tokens) and
endpoints are common in ordinary text, so they count only when complementary parts
co-occur: an interval join links parts of the same document that stand apart, but within
SCOPE code points of each other.  What overlaps a part is no complement of it: the path of
an address is not the secret to that address.

Positions come from splitting: the pieces between matches and the matches, in turn, make
up the text, so a running sum of their lengths is where each match starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

# The base patterns.  A match of `assign` must have a value (group 2) of 12
# characters or more, one of `access` 18 characters or more, one of `hex` 16 or more.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Parts that need a complement: a token of 20 characters or more with a capital, a small
# letter and a digit, and a host name after a scheme.
WEAK = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?i)(?:https?|jdbc:[a-z0-9]+|postgres|mysql|redis|amqp|s3)://[^\x00-\x20\x22\x27<>]+"
KINDS = ("assign", "access", "hex", "weak", "endpoint")
#: Code points between linked parts.
SCOPE = 256


def _found(text: Column, kind: str) -> Column:
    """Array of (gap before, length, valid) of the matches; null without matches."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK, "endpoint": ENDPOINT}[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "assign":
        valid = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= 12)
    elif kind == "weak":
        valid = F.transform(whole, lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]"))
    else:
        valid = F.transform(whole, lambda v: F.lit(True))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("len"), valid.alias("valid"))
    return F.when(text.rlike(pattern), zipped)


def _linked(parts: DataFrame, asking: Column, answering: Column) -> DataFrame:
    """Asking parts with an answering part of the same text within SCOPE.  Both are dealt
    to buckets of SCOPE code points, so no two parts far from each other ever meet."""
    left = parts.filter(asking).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))))
    right = parts.filter(answering).select("id", "digest", F.col("start").alias("s"), F.col("end").alias("e"))
    right = right.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / SCOPE), F.floor(F.col("e") / SCOPE))))
    near = left.alias("l").join(
        right.alias("r"),
        (F.col("l.id") == F.col("r.id")) & (F.col("l.digest") == F.col("r.digest")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("s") < F.col("end") + SCOPE) & (F.col("e") > F.col("start") - SCOPE) & ((F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))),
        "left_semi",
    )
    return near.select("id", "digest", "kind", "start", "end").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """All spans of all texts: (id, digest) of the text, kind, start, end, one row each.

    Also returned by ``spans`` with counts.  ``docs`` needs doc_id and text; whole texts
    are searched.  Matches are leftmost and don't overlap within a kind; positions are
    code points, the end exclusive.  A null text is empty and has no spans; rows that repeat
    have their spans once; a null doc_id has the smallest long as id; an empty table gives
    no rows; other columns are ignored.
    """
    return _spans(_texts(docs))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = [F.col("doc_id"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, F.length(text)).alias("digest")]
    return cut(docs.select(*key, *[_found(text, k).alias(k) for k in KINDS]))


def _spans(texts: DataFrame) -> DataFrame:
    some = texts.filter(F.coalesce(*KINDS).isNotNull())
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in KINDS])
    rows = some.select("id", "digest", F.explode(kinds).alias("k")).select("id", "digest", "k.kind", F.posexplode("k.found").alias("n", "f"))
    rows = rows.select("id", "digest", "kind", "n", "f.gap", "f.len", "f.valid").dropDuplicates(["id", "digest", "kind", "n"])
    before = Window.partitionBy("id", "digest", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).filter("valid")
    parts = cut(rows.select("id", "digest", "kind", (F.col("end") - F.col("len")).alias("start"), "end"))
    base, weak, endpoint = F.col("kind").isin("assign", "access", "hex"), F.col("kind") == "weak", F.col("kind") == "endpoint"
    # a weak secret needs an identifier or an endpoint, an endpoint a base part
    added = _linked(parts, weak, F.col("kind").isin("access", "endpoint")).unionByName(_linked(parts, endpoint, base))
    return parts.filter(base).unionByName(added)


def spans(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored).

    doc_id; n_assign, n_access, n_hex: base spans; n_linked: added weak secrets and
    endpoints; base_sha256: lowercase hex of the base spans as ``kind:start:end`` by
    start, then kind as listed, joined by commas; spans: all spans joined likewise.

    A null text is empty; a text without spans has zero counts, the digest of the empty
    string and an empty list.  Repeated rows repeat; an empty table gives no rows.
    """
    texts = _texts(docs)
    found = _spans(texts)
    rank = F.expr("array_position(array('assign','access','hex','weak','endpoint'), kind)")
    one = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["span"]), ",")
    base = F.col("kind").isin("assign", "access", "hex")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    rows = found.groupBy("id", "digest").agg(*counts, F.count_if(~base).alias("n_linked"), joined(F.collect_list(F.when(base, one))).alias("base"), joined(F.collect_list(one)).alias("spans"))
    out = texts.select("doc_id", "id", "digest").join(rows, ["id", "digest"], "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_assign", "n_access", "n_hex", "n_linked")]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


#: Texts with spans whose spans are broadcast rather than shuffled with the texts.
FEW = 1 << 17


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in the place of every span of ``scan`` (overlaps as one).

    Texts without spans, null texts among them, stay as they are; all columns are kept,
    repeated rows repeat, and an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    found = cut(scan(docs).withColumnsRenamed({"id": "_secret_id", "digest": "_secret_digest"}).groupBy("_secret_id", "_secret_digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_secret_found")))
    keyed = docs.withColumns({"_secret_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_secret_digest": F.xxhash64(text, F.length(text))})
    keyed = keyed.join(small_side(found, FEW), ["_secret_id", "_secret_digest"], "left")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cover(state, span):
        gap = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        put = F.concat(state["out"], gap, F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(span["start"] >= state["at"], put).otherwise(state["out"]).alias("out"))

    whole = F.aggregate("_secret_found", first, cover, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return keyed.withColumn("text", F.when(F.col("_secret_found").isNotNull(), whole).otherwise(F.col("text"))).drop("_secret_id", "_secret_digest", "_secret_found")
