"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for one text, the polynomial hashes of all its prefixes modulo two
primes.  The hash of any span is a difference of two entries times a power of the
inverse base, so span equality takes O(1) and the longest common extension of two
positions takes a binary search.  A fingerprint is the hash of the whole text with a
bottom-k sketch of the hashes of all its spans of SPAN code points; the likeness of two
fingerprints is the sketches' estimate of the share of spans that the texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, tidy
from .hashing import mix

U64 = np.uint64
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Code points of a span, values of a sketch, and code points hashed together.
SPAN, SKETCH, STRETCH = 8, 48, 1 << 18
#: Points of a range search that are compared one after another in a tree.
TREE = 256


def _powers(base: int, p: int) -> np.ndarray:
    """The first STRETCH powers of ``base`` modulo ``p``."""
    out = np.ones(1, U64)
    while len(out) < STRETCH:
        out = np.concatenate([out, out * U64(pow(base, len(out), p)) % U64(p)])
    return out[:STRETCH]


_INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES))
_UP, _DOWN = ([_powers(b, p) for b, p in zip(bases, PRIMES)] for bases in (BASES, _INVERSES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Prefixes:
    """Hashes of all prefixes of a text given as code points: two numbers below 2**31 for
    each, eight bytes a code point.  They are made, and spans are read from them, by
    stretches of a fixed size, so a text of any length needs no more than that besides."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for p, base, up in zip(PRIMES, BASES, _UP):
            sums = np.zeros(self.n + 1, np.uint32)
            for at in range(0, self.n, STRETCH):
                values = points[at : at + STRETCH].astype(U64) + U64(1)
                part = np.cumsum(values * up[: len(values)] % U64(p)) % U64(p)
                sums[at + 1 : at + 1 + len(values)] = (part * U64(pow(base, at, p)) + U64(sums[at])) % U64(p)
            self.sums.append(sums)

    def spans(self, width: int) -> Iterator[np.ndarray]:
        """64-bit hashes of every span of ``width`` code points, a stretch at a time."""
        m = self.n - width + 1
        for at in range(0, m, STRETCH):
            end = min(m, at + STRETCH)
            parts = []
            for p, inverse, s, down in zip(PRIMES, _INVERSES, self.sums, _DOWN):
                raw = (s[at + width : end + width].astype(U64) + U64(p) - s[at:end]) % U64(p)
                parts.append(raw * down[: end - at] % U64(p) * U64(pow(inverse, at, p)) % U64(p))
            yield mix(parts[0] << U64(32) | parts[1])

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of one span; equal spans of any two texts have equal hashes."""
        return tuple((int(s[end]) - int(s[start])) * pow(inverse, start, p) % p for p, inverse, s in zip(PRIMES, _INVERSES, self.sums))

    def whole(self) -> str:
        return "%08x%08x" % self.span(0, self.n)


def common_extension(a: Prefixes, b: Prefixes, i: int = 0, j: int = 0) -> int:
    """Code points for which a from i and b from j agree, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(prefixes: Prefixes) -> np.ndarray:
    """The SKETCH smallest distinct span hashes, as 32-bit numbers in ascending order; a
    text shorter than a span is one span."""
    least = np.empty(0, U64)
    if prefixes.n:
        for hashes in prefixes.spans(min(SPAN, prefixes.n)):
            values, take = hashes >> U64(32), 4 * SKETCH
            while True:
                some = np.unique(np.partition(values, take)[:take] if len(values) > take else values)
                if len(some) >= SKETCH or take >= len(values):
                    break
                take *= 4
            least = np.union1d(least, some)[:SKETCH]
    return least


def fingerprint(prefixes: Prefixes, least: np.ndarray) -> str:
    """Length, hash of the whole and sketch; equal for equal texts."""
    return f"{prefixes.n:x}-{prefixes.whole()}-" + "".join("%08x" % v for v in least.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of spans in common, 0 to 1; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, a).__and__(np.isin(union, b)).sum() / len(union))


def parse(text: str) -> np.ndarray:
    """The sketch in a fingerprint."""
    part = text.rsplit("-", 1)[1]
    return np.array([int(part[i : i + 8], 16) for i in range(0, len(part), 8)], U64)


def _tree(order: Column, points: list[int], at: int = 0) -> Column:
    if not points:
        return F.lit(at)
    m = len(points) // 2
    return F.when(order < points[m], _tree(order, points[:m], at)).otherwise(_tree(order, points[m + 1 :], at + m + 1))


def _range_of(order: Column, points: list[int]) -> Column:
    """Index of the range of ``order`` among ascending points: a balanced tree, and for
    very many points a tree over runs of them and then the points of the run."""
    if len(points) <= TREE:
        return _tree(order, points)
    step = -(-len(points) // TREE)
    runs = [points[i : i + step] for i in range(0, len(points), step)]
    run = _tree(order, [r[0] for r in runs[1:]])
    within = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), run + 1)
    return run * step + F.size(F.filter(within, lambda p: p <= order))


def with_next(docs: DataFrame) -> DataFrame:
    """Deals whole texts to ranges of doc_id, each sorted descending and followed by the
    first row of the range below (rows with ``edge``); the lowest is followed by the
    highest of all.  One shuffle moves each text once, and only edges twice.

    There are as many ranges as the session has shuffle partitions, one a task.  A null
    doc_id comes after all others; rows with equal ids follow by text hash.
    """
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(order.alias("o"))
    count = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = ids.agg(F.percentile_approx("o", [i / count for i in range(1, count)] or [0.5], max(10000, 20 * count)).alias("p")).first()["p"] or []
    points = sorted(set(at)) if count > 1 else []
    which = _range_of(order, points)
    tops = {r["range"]: r["top"] for r in ids.select(_range_of(F.col("o"), points).alias("range"), "o").groupBy("range").agg(F.max("o").alias("top")).collect()}
    # the top of a range also goes to the next range above it that has rows, the highest to the lowest
    held = sorted(tops)
    above = dict(zip(held, held[1:] + held[:1]))
    every = range(max(held, default=0) + 1)
    known = lambda table, kind: F.element_at(F.array(*[F.lit(table.get(r)).cast(kind) for r in every]), which + 1)
    to = F.when(order == known(tops, "long"), known(above, "int"))
    copies = F.filter(F.array(F.struct(which.alias("range"), F.lit(False).alias("edge")), F.struct(to.alias("range"), F.lit(True).alias("edge"))), lambda c: c["range"].isNotNull())
    rows = docs.select("doc_id", "text", order.alias("o"), F.xxhash64("text").alias("tie"), F.explode(copies).alias("c"))
    rows = rows.select("doc_id", "text", "o", "tie", "c.range", "c.edge")
    return rows.repartitionById(count, "range").sortWithinPartitions("range", "edge", F.desc("o"), "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document.

    ``docs`` (doc_id, text; other columns are ignored): a null text is empty.  The next
    document is the one with the next smaller doc_id (after the smallest: the largest);
    a table of one row is its own next.  The edited text replaces the last
    ``floor(n_chars / 2)`` code points by the first as many (or all) of the next.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and common_prefix: the longest common extension of text and edit.
    Repeated rows repeat, each with its own next; an empty table gives no rows.
    """
    rows = with_next(docs)

    def one(doc_id, points, near):
        # near: code points of the next document
        keep = len(points) - len(points) // 2
        edited = np.concatenate([points[:keep], near[: len(points) // 2]])
        z = sketch(Prefixes(near))
        a, b = Prefixes(points), Prefixes(edited)
        x, y = sketch(a), sketch(b)
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
        return doc_id, a.n, digest, fingerprint(a, x), fingerprint(b, y), likeness(x, y), likeness(x, z), common_extension(a, b)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def build(batches):
        held, served = None, None
        for batch in batches:
            out = []
            for doc_id, text, span, edge in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("range").to_pylist(), batch.column("edge").to_pylist()):
                points = code_points(text.decode())
                if held is not None and served != span and held[2] == span:
                    out.append(one(held[0], held[1], points))
                if edge:
                    served, held = span, None
                else:
                    held = (doc_id, points, span)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return lean(rows).mapInArrow(tidy(build), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")
